"""Files in the shared folder, from executors: local and mounted paths directly, others by pyarrow."""

from __future__ import annotations

import os
from typing import IO, Any
from urllib.parse import unquote, urlparse


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


def open_write(path: str) -> IO[bytes] | Any:
    if (p := _local(path)) is not None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        return open(p, "wb")
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(p), recursive=True)
    return store.open_output_stream(p)


def open_read(path: str) -> IO[bytes] | Any:
    if (p := _local(path)) is not None:
        return open(p, "rb")
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    return store.open_input_file(p)
