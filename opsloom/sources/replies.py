"""Replies kept per message while a responder is asked, so that no message is asked for twice.

Tasks write a reply as soon as they have it. A task that runs again, or a run after one that failed, reads it back
and asks only for what is not there. The folder belongs to one run and goes when the run's replies are stored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import urlsplit

import pyarrow.fs


class ReplyLedger:
    """One small file per message below a folder that every executor reaches; used inside tasks."""

    def __init__(self, folder: str):
        # a plain path, or the address of a store
        location = folder if urlsplit(folder).scheme else f"file://{folder}"
        self._fs, self._root = pyarrow.fs.FileSystem.from_uri(location)

    def _file(self, key: object) -> str:
        name = hashlib.sha256(repr(key).encode()).hexdigest()
        return f"{self._root}/{name[:2]}/{name}"

    def get(self, key: object) -> list | None:
        """The reply committed for a key, as it was given."""
        file = self._file(key)
        if self._fs.get_file_info(file).type != pyarrow.fs.FileType.File:
            return None
        with self._fs.open_input_stream(file) as stream:
            return json.loads(stream.read())

    def put(self, key: object, reply: list) -> None:
        """Commit a reply: written whole beside its place, then moved there."""
        file = self._file(key)
        self._fs.create_dir(file.rsplit("/", 1)[0], recursive=True)
        beside = f"{file}.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(beside) as stream:
            stream.write(json.dumps(reply).encode())
        self._fs.move(beside, file)
