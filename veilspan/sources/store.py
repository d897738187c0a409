"""Files as tasks open them: any name, any range of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

OTHERS_MAY_WORK = (PermissionError, FileNotFoundError, IsADirectoryError)


def _parts(path: str) -> tuple[str, str]:
    """(address of the file system, path in it); paths are plain text, never percent-encoded."""
    if path.startswith("file:"):
        return "", "/" + path[5:].lstrip("/")
    if "://" not in path:
        return "", path
    scheme, rest = path.split("://", 1)
    host, _, below = rest.partition("/")
    return f"{scheme}://{host}", f"/{below}"


@lru_cache(maxsize=16)
def _file_system(address: str):
    from pyarrow import fs  # in the task only: it starts threads of its own

    if not address:
        return fs.LocalFileSystem(), ""
    store, base = fs.FileSystem.from_uri(address + "/")
    return store, base.rstrip("/")  # object stores name the bucket in the path


def _opened(path: str):
    address, below = _parts(path)
    store, base = _file_system(address)
    return store, base + below


def reachable(path: str) -> bool:
    """Whether tasks can open the store without Spark; others are read by Spark's own sources."""
    try:
        _opened(path)
    except Exception:  # no such scheme here, or none of its libraries
        return False
    return True


def entries(path: str) -> Iterator[tuple[str, bool, int | None, object]]:
    """(path, is a folder, size, time) of what a folder holds, or of the file itself."""
    from pyarrow import fs

    store, inside = _opened(path)
    found = store.get_file_info(inside)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    address = _parts(path)[0]
    base = _file_system(address)[1]
    for f in [found] if found.is_file else store.get_file_info(fs.FileSelector(inside)):
        if f.is_file or f.type == fs.FileType.Directory:
            yield f"{address or 'file:'}{f.path.removeprefix(base)}", not f.is_file, f.size, f.mtime


def opened(path: str):
    """An open file with read, seek and size."""
    store, inside = _opened(path)
    return store.open_input_file(inside)


def read_range(path: str, begin: int, end: int) -> bytes:
    """Bytes of a file from ``begin`` to before ``end``, or to its end."""
    with opened(path) as f:
        f.seek(begin)
        return f.read(max(end - begin, 0))
