"""Small files in folders of any kind that Arrow opens (local, HDFS, object stores), on the driver and on executors."""

from __future__ import annotations

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder's URI or local path."""
    if folder.startswith(("/", "file:")) or "://" not in folder:
        place = "/" + folder.split(":", 1)[-1].lstrip("/") if folder.startswith(("/", "file:")) else folder
        return fs.LocalFileSystem(), place.rstrip("/")
    system, place = fs.FileSystem.from_uri(folder)
    return system, place.rstrip("/")


def write_text(folder: str, name: str, text: str) -> None:
    """One file, seen whole or not at all where the file system can rename."""
    system, place = opened(folder)
    system.create_dir(place, recursive=True)
    partial = f"{place}/.{name}.part"
    with system.open_output_stream(partial) as out:
        out.write(text.encode())
    system.move(partial, f"{place}/{name}")


def read_text(folder: str, name: str) -> str | None:
    system, place = opened(folder)
    if system.get_file_info(f"{place}/{name}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{place}/{name}") as source:
        return source.read().decode()


def finished_versions(folder: str) -> list[int]:
    """Numbers of the sub-folders v=<number> that hold a finished table."""
    system, place = opened(folder)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return []
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.base_name.startswith("v=")]
    return sorted(int(name[2:]) for name in found if system.get_file_info(f"{place}/{name}/_SUCCESS").type == fs.FileType.File)
