"""Byte streams on the shared store, for tasks that read or write files of their own.

Spark's readers and writers cover tables. Archives are neither, so a task opens them itself,
on the store that the path names and never on a folder of its own machine unless the
path says so.
"""

from __future__ import annotations

from pyarrow import NativeFile, fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it.

    Takes what Hadoop takes: a bare path or ``file:/path`` for a shared mount, ``hdfs://host/path``,
    ``s3a://bucket/path``, ``gs://bucket/path``. Other schemes are refused with an error.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


def open_seekable(path: str) -> NativeFile:
    """A file for reading in any order."""
    store, inside = locate(path)
    return store.open_input_file(inside)


def open_stream(path: str) -> NativeFile:
    """A file for reading from its start, as it is, whatever its ending."""
    store, inside = locate(path)
    return store.open_input_stream(inside, compression=None)


def create(path: str) -> NativeFile:
    """A new file for writing, with the folders above it."""
    store, inside = locate(path)
    store.create_dir(inside.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inside, compression=None)


def files_in(path: str, ending: str) -> list[str]:
    """The path itself where it is a file, else the files of that ending in the folder, in order of name."""
    store, inside = locate(path)
    if store.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    found = store.get_file_info(fs.FileSelector(inside))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(ending)]
