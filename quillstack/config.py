"""Configuration: a frozen record, strict about its keys."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: What a post URL never contains (plain substrings, lower case).
REJECTED_PARTS = (
    "/admin", "/login", "/contact", "/about", "/home", ".pdf", ".jpg", ".png", ".gif", ".css", ".js", "mailto:", "tel:", "#", "javascript:",
)
#: Sections that hold posts in common layouts.
POST_SECTIONS = ("/blog/", "/post/", "/posts/", "/article/", "/articles/", "/news/", "/writing/", "/journal/", "/entry/")
#: Sections that a connectivity probe looks for.
PROBE_SECTIONS = ("/blog/", "/post/", "/posts/", "/article/", "/articles/")


@dataclass(frozen=True)
class UrlProfile:
    """What the URLs of one site's posts look like; section indexes themselves are given by ``closed``."""

    required: tuple[str, ...] = POST_SECTIONS
    rejected: tuple[str, ...] = REJECTED_PARTS
    closed: tuple[str, ...] = ()
    min_parts: int = 3
    min_slug: int = 4
    deep_parts: int = 5

    @property
    def refused(self) -> tuple[str, ...]:
        return (*self.rejected, *self.closed)


@dataclass(frozen=True)
class Config:
    site_url: str = "https://example.com/"
    default_author: str = ""
    sections: tuple[str, ...] = ("blog",)
    keep_backup: bool = True
    urls: UrlProfile = field(default_factory=UrlProfile)


def _build(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(unknown))}")
    nested = {"urls": UrlProfile}
    return kind(**{k: _build(nested[k], v) if kind is Config and k in nested else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_config(path: str | None = None) -> Config:
    """Configuration of a JSON file; the defaults if there is no file; an error for keys that nothing reads."""
    if path is None or not Path(path).exists():
        return Config()
    return _build(Config, json.loads(Path(path).read_text(encoding="utf-8")))


def save_config(config: Config, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(config), indent=2, sort_keys=True), encoding="utf-8")
