"""Single files and directories from inside a task, on any file system Arrow knows."""

import io
import re

from pyarrow import fs


class _Handle(io.RawIOBase):
    """An Arrow file that answers a wrong seek with OSError, as Python's own files do."""

    def __init__(self, source):
        self._source = source

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self._source.tell()

    def seek(self, offset, whence=io.SEEK_SET):
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.tell(), io.SEEK_END: self._source.size()}[whence]
        if start + offset < 0:
            raise OSError("seek before the start of the file")
        return self._source.seek(start + offset)

    def readinto(self, buffer):
        data = self._source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self):
        self._source.close()
        super().close()


def _system_at(path):
    """(file system, path in it, address of its root, path of its root) of a ``scheme://`` address; None for a local path."""
    address = re.fullmatch(r"(?s)(\w[\w+.-]+)://([^/]*)/?(.*)", path)
    if not address or path.startswith("file:"):
        return None
    scheme, host, rest = address.groups()
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, root = fs.FileSystem.from_uri(f"{known}://{host}/")
    root = root.rstrip("/")
    return system, f"{root}/{rest}", f"{scheme}://{host}", root


def local_path(path):
    """A plain path for a ``file:`` address, other paths as they are."""
    return re.sub(r"^file:(//)?", "", path)


def open_for_reading(path):
    """A seekable binary handle on a plain path or a ``scheme:`` address as Spark shows it.

    Addresses are taken as they are, without percent decoding.
    """
    found = _system_at(path)
    if found is None:
        return open(local_path(path), "rb")
    system, inside, _, _ = found
    return io.BufferedReader(_Handle(system.open_input_file(inside)))


def open_for_writing(path):
    """A binary handle that writes a new file at a plain path or an address; directories are made."""
    found = _system_at(path)
    system, inside = (fs.LocalFileSystem(), local_path(path)) if found is None else found[:2]
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inside)


def listed_at(path):
    """(path, name, is_dir, size, modified in ns) of what lies directly in a ``scheme://`` directory.

    None for a local path. The store's own listing brings size and time along, so no entry is asked for alone.
    """
    found = _system_at(path)
    if found is None:
        return None
    system, inside, prefix, root = found
    entries = system.get_file_info(fs.FileSelector(inside.rstrip("/") or "/"))
    return (
        (
            f"{prefix}/{entry.path[len(root):].lstrip('/')}", entry.base_name, entry.type == fs.FileType.Directory,
            entry.size, entry.mtime_ns,
        )
        for entry in entries
    )
