"""URL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import POST_SECTIONS, PROBE_SECTIONS, REJECTED_PARTS, UrlProfile


def any_of(parts: tuple[str, ...]) -> str:
    """Regular expression for any of some plain substrings."""
    return "|".join(re.escape(p).replace("/", "/") for p in parts)


def path_of(url: Column) -> Column:
    """Path of a URL of any form, relative ones and ones with odd characters too."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), F.lit(""))


def path_parts(url: Column) -> Column:
    """Non-empty parts of the path."""
    return F.filter(F.split(path_of(url), "/"), lambda p: p != "")


def last_part(url: Column) -> Column:
    return F.coalesce(F.try_element_at(path_parts(url), F.lit(-1)), F.lit(""))


def is_post_url(url: Column, profile: UrlProfile = UrlProfile()) -> Column:
    """Post URL by a site's profile: nothing refused in it, a post section, and a path deep or telling enough."""
    low = F.lower(url)
    parts = path_parts(url)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    telling = (F.length(last) >= profile.min_slug) & last.rlike(r"[-\p{L}]")
    return F.coalesce(
        ~low.rlike(any_of(profile.refused)) & low.rlike(any_of(profile.required)) & (F.size(parts) >= profile.min_parts) & (telling | (F.size(parts) >= profile.deep_parts)),
        F.lit(False),
    )


def looks_like_post(url: Column) -> Column:
    """Weaker test of a site explorer: a post section, or a slug of letters, digits and hyphens at the end."""
    low = F.lower(url)
    last = F.coalesce(F.try_element_at(path_parts(low), F.lit(-1)), F.lit(""))
    return F.coalesce(~low.rlike(any_of(REJECTED_PARTS)) & (low.rlike(any_of(POST_SECTIONS)) | (last.rlike("^[a-z0-9-]+$") & (F.length(last) > 3))), F.lit(False))


def in_probe_section(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(any_of(PROBE_SECTIONS)), F.lit(False))


def url_pattern(url: Column) -> Column:
    """Layout that a URL shows, null if none: a part named blog, post or article, in this order."""
    parts = path_parts(url)
    deep = F.size(parts) >= 2
    out = F.lit(None).cast("string")
    for name in ("article", "post", "blog"):
        out = F.when(deep & F.array_contains(parts, name), F.lit("/" + name + "/{slug}")).otherwise(out)
    return out


def canonical_url(url: Column) -> Column:
    """scheme://host/path: query, parameters and fragment go; null unless it starts with http and has a host."""
    bare = F.regexp_replace(F.trim(url), r"[?#;].*$", "")
    return F.when(bare.rlike(r"^https?://[^/]+"), bare)


def secured(url: Column, site_url: str) -> Column:
    """http becomes https where the host is that of a site served by https."""
    if not site_url.startswith("https://"):
        return url
    host = re.match(r"https://([^/]+)", site_url)[1]
    return F.when(url.rlike("^http://" + re.escape(host) + "(/|$)"), F.regexp_replace(url, "^http:", "https:")).otherwise(url)


def post_id(url: Column) -> Column:
    """Parts two to five joined by hyphens if there are five parts, else the last part, else "unknown"."""
    parts = path_parts(url)
    return F.when(F.size(parts) >= 5, F.concat_ws("-", F.slice(parts, 2, 4))).when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1))).otherwise(F.lit("unknown"))


def historical_id(url: Column) -> Column:
    """The last two parts joined by an underscore."""
    parts = path_parts(url)
    return F.when(F.size(parts) >= 2, F.concat_ws("_", F.slice(parts, -2, 2))).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown")))


def slug_of(url: Column) -> Column:
    """What stands behind the last slash, whatever it is."""
    return F.element_at(F.split(url, "/"), -1)


def url_date(url: Column) -> Column:
    """Date of the path's parts two to four: a four-digit year, month and day; null for impossible ones."""
    parts = path_parts(url)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    number = lambda k, digits: F.when(at(k).rlike(f"^[0-9]{{{digits}}}$"), at(k).cast("int"))
    return F.try_make_timestamp(number(2, "4"), number(3, "1,2"), number(4, "1,2"), F.lit(0), F.lit(0), F.lit(0))


def year_month(url: Column) -> tuple[Column, Column]:
    """First /yyyy/m/ or /yyyy/mm/ of a URL as strings; empty without."""
    pattern = r"/([0-9]{4})/([0-9]{1,2})/"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)


def first_year(url: Column, low: int, high: int) -> Column:
    """Smallest year low..high that stands between slashes; null without. Neighbours may share a slash."""
    parts = F.split(url, "/")
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    years = F.transform(F.filter(inner, lambda p: p.rlike("^[0-9]{4}$")), lambda p: p.cast("int"))
    return F.array_min(F.filter(years, lambda y: (y >= low) & (y <= high)))


def is_historical(url: Column, sections: tuple[str, ...] = ("/blog/",), low: int = 2005, high: int = 2014) -> Column:
    """A post section and a year low..high between slashes, and no tag, category or page listing."""
    return F.coalesce(first_year(url, low, high).isNotNull() & url.rlike(any_of(sections)) & ~url.rlike(any_of(("/tag/", "/category/", "/p/"))), F.lit(False))


def link_type(url: Column, site_url: str) -> Column:
    low = F.lower(url)
    return F.when(low.startswith("mailto:"), "email").when(low.startswith("tel:"), "phone").when(url.contains(site_url), "internal").otherwise("external")


def without_dots(url: Column) -> Column:
    """The URL with the . and .. segments of its path resolved, none above the root."""
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(root) + 1, F.length(url))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    tail = F.substring(rest, F.length(path) + 1, F.length(rest))
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none)
    kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", up(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    ends = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when((root != "") & path.rlike(r"/\.{1,2}(/|$)"), F.concat(root, F.lit("/"), F.array_join(kept, "/"), ends, tail)).otherwise(url)


def absolute_url(href: Column, site_url: str, page_url: Column) -> Column:
    """RFC 3986 for the forms that pages use: //host, /path, ?query, #fragment, relative path with . and .., full URL."""
    root = re.match(r"[a-z]+://[^/]+", site_url)[0]
    scheme = root.split(":")[0]
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    page_root = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    folder = F.when(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "") == "", F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    folder = F.when(F.length(folder) > F.length(page_root), folder).otherwise(F.concat(page_root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.startswith("/"), without_dots(F.concat(F.lit(root), href)))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, "#.*$", ""), href))
        .otherwise(without_dots(F.concat(folder, href)))
    )


def page_template(base: Column, template: Column, page: Column) -> Column:
    """A listing URL: {} becomes the page; a leading ? becomes & where the base has a query already."""
    fitted = F.when(base.contains("?") & template.startswith("?"), F.concat(F.lit("&"), F.substring(template, 2, 1000))).otherwise(template)
    return F.concat(base, F.replace(fitted, F.lit("{}"), page.cast("string")))


def image_filename(url: Column) -> Column:
    """Local name of an image: the URL's own name made safe, eight digits of its MD5 and its type; by MD5 alone without a known type."""
    name = last_part(url)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    digest = F.md5(url)
    return F.when(kind.isin("jpg", "jpeg", "png", "gif", "webp", "svg"), F.concat(safe_filename(stem), F.lit("_"), F.substring(digest, 1, 8), F.lit("."), kind)).otherwise(F.concat(F.lit("image_"), digest, F.lit(".jpg")))


def safe_filename(name: Column) -> Column:
    """Letters, digits, _ - and . stay, runs of others become one underscore; 50 characters at most, no outer underscores."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_"), "_+", "_")
    return F.regexp_replace(F.substring(clean, 1, 50), "^_+|_+$", "")
