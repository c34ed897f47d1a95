"""Opening files by local path or address (``scheme://...``), on the driver and in tasks alike."""

from __future__ import annotations

import os

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_input(path: str):
    """A binary file to read, with seek and tell."""
    system, name = _place(path)
    return system.open_input_file(name)


def open_output(path: str):
    system, name = _place(path)
    return system.open_output_stream(name)


def exists(path: str) -> bool:
    system, name = _place(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def size_of(path: str) -> int:
    system, name = _place(path)
    return system.get_file_info(name).size


def make_folder(path: str) -> None:
    system, name = _place(path)
    system.create_dir(name, recursive=True)


def move(old: str, new: str) -> None:
    system, name = _place(old)
    system.move(name, _place(new)[1])


def remove(path: str) -> None:
    """Delete a file or folder, if it exists."""
    system, name = _place(path)
    kind = system.get_file_info(name).type
    if kind == fs.FileType.Directory:
        system.delete_dir(name)
    elif kind == fs.FileType.File:
        system.delete_file(name)


def listing(folder: str) -> list[str]:
    """Paths of the files directly in a folder."""
    system, name = _place(folder)
    found = system.get_file_info(fs.FileSelector(name))
    return sorted(join(folder, f.base_name) for f in found if f.type == fs.FileType.File)


def read_text(path: str) -> str:
    with open_input(path) as file:
        return file.read().decode("utf-8")


def write_text(path: str, text: str) -> None:
    """Replace a file as a whole: written beside it, then moved there."""
    with open_output(path + ".new") as file:
        file.write(text.encode("utf-8"))
    move(path + ".new", path)


def join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"
