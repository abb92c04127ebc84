"""Small files in a folder that driver and tasks share, through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def writer(folder: str, name: str):
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return store.open_output_stream(f"{base}/{name}", compression=None)


@contextlib.contextmanager
def whole_file(folder: str, name: str):
    """A stream to a file that gets its name at the end, and none if writing fails."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft, compression=None) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(draft)
        raise
    store.move(draft, f"{base}/{name}")


def replace(folder: str, name: str, data: bytes) -> None:
    """Readers find the old file or the new one, whole: it gets its name once it is written."""
    with whole_file(folder, name) as out:
        out.write(data)


def read(folder: str, name: str) -> bytes:
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()


def listed(folder: str, prefix: str) -> list[str]:
    store, base = _open(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return [f.base_name for f in found if f.type == fs.FileType.File and f.base_name.startswith(prefix)]


def remove(folder: str, name: str) -> None:
    store, base = _open(folder)
    store.delete_file(f"{base}/{name}")
