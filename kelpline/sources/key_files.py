"""A file a key: many small documents a task, published only when all tasks are done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Files that are moved to their place at the same time.
AT_ONCE = 32


@dataclass
class Written(WriterCommitMessage):
    """A task's folder; its file names are listed from there, they don't pass through the driver's messages."""

    folder: str
    files: int


class KeyFileWriter(DataSourceWriter):
    """Tasks write into folders of their own below ``_temporary``; commit moves the files, abort and failed tasks leave nothing."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.job = path, suffix, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        return store, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._store()
        folder, seen = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}", set()
        store.create_dir(folder, recursive=True)
        try:
            for key, value in iterator:
                if key is None or key in seen:
                    raise ValueError(f"two documents or none for one file name: {key!r}")
                seen.add(key)
                with store.open_output_stream(f"{folder}/{key}{self.suffix}") as out:
                    out.write((value or "").encode())
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for m in messages:
                if m is not None and m.files:
                    names = [f.base_name for f in store.get_file_info(fs.FileSelector(m.folder))]
                    list(pool.map(lambda n, m=m: store.move(f"{m.folder}/{n}", f"{base}/{n}"), names))
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        for path in (f"{base}/_temporary/{self.job}", f"{base}/_temporary"):
            if store.get_file_info(path).type == fs.FileType.Directory and (path.endswith(self.job) or not store.get_file_info(fs.FileSelector(path))):
                store.delete_dir(path)


class KeyFiles(DataSource):
    """Format ``key_files``, for writing rows of a file name and its text. Options: ``path``, ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "key_files"

    def schema(self) -> str:
        return "key string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return KeyFileWriter(self.options["path"], self.options.get("suffix", ""))
