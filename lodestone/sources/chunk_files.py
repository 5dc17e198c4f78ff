"""A sink of one JSON file for each row: executors write, the driver publishes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What the folder holds after a write that went through: how many rows the files stand for.
DONE = "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    rows: int


class Writer(DataSourceWriter):
    """A task writes into a folder of its own, so that one that fails or runs twice leaves nothing that counts; commit moves the files of the tasks that made it, abort takes all folders away (a task that is still being killed may leave an unused one, whose name begins with _staging-)."""

    def __init__(self, path: str, name: str, weight: str | None) -> None:
        self.path, self.name, self.weight = path, name, weight
        self.staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store, own = self._store(folder)
        store.create_dir(own, recursive=True)
        rows = 0
        try:
            for row in iterator:
                held = {k: v for k, v in row.asDict(recursive=True).items() if v is not None and k != self.weight}
                with store.open_output_stream(f"{own}/{held[self.name]}.json") as f:
                    f.write(json.dumps(held, ensure_ascii=False, indent=2).encode())
                rows += row[self.weight] if self.weight else 1
        except BaseException:
            store.delete_dir(own)
            raise
        return Written(folder, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._store(self.path)
        store.create_dir(path, recursive=True)
        made = [m for m in messages if m is not None]
        for m in made:
            for info in store.get_file_info(fs.FileSelector(self._store(m.folder)[1])):
                store.move(info.path, f"{path}/{info.base_name}")
        self._clear()
        with store.open_output_stream(f"{path}/{DONE}") as f:
            f.write(json.dumps({"rows": sum(m.rows for m in made)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = self._store(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class ChunkFiles(DataSource):
    """Writes rows as <name>.json of the columns that aren't null, as indented text. Options: path; name, the column that names the file (id); weight, a column that isn't written but counted."""

    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("name", "id"), self.options.get("weight"))


def rows_written(path: str) -> int:
    store, own = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{own}/{DONE}") as f:
        return json.loads(f.read())["rows"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkFiles)
