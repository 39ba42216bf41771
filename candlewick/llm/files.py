"""Binary files in the shared folder, written and read by tasks.

Names are new for every attempt and only what a task returns is read later, so a task that is lost
or runs twice leaves at most a file that nothing names.
"""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith(("/", "file:")) else (fs.LocalFileSystem(), uri)


def new_folder(root: str, name: str) -> str:
    uri = f"{root.rstrip('/')}/{name}-{uuid4().hex}"
    system, path = place(uri)
    system.create_dir(path)
    return uri


def new_file(folder: str, ending: str):
    """A new file in ``folder``: its URI and an open stream."""
    uri = f"{folder}/{uuid4().hex}{ending}"
    system, path = place(uri)
    return uri, system.open_output_stream(path, compression=None)


def read_at(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
