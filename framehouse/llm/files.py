"""Files beside tables: opened by URI through pyarrow, so that the shared folder may be any store that it knows."""

from __future__ import annotations

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def put(uri: str, name: str, attempt: str, parts) -> int:
    """Write the parts as one file, under another name until it is whole: a lost or repeated task leaves the same file."""
    store, base = file_system(uri)
    store.create_dir(base, recursive=True)
    size = 0
    with store.open_output_stream(f"{base}/.{name}.{attempt}", compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
    return size


def get(uri: str, name: str, offset: int = 0, length: int | None = None) -> bytes:
    store, base = file_system(uri)
    with store.open_input_file(f"{base}/{name}") as f:
        f.seek(offset)
        return f.read(length)
