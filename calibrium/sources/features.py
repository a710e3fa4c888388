"""Feature matrices as a Spark data source: `spark.read.format("features").load(path)` and `df.write.format("features")`.

A folder holds block files and an index. A block is at most `block_rows` rows: their ids (64-bit) and then their features
(32-bit floats, row by row), all little-endian. The index names every block with its rows, width and sha256, and is
written last. A reader takes a partition per block and checks its digest and shape before it gives a row of it, so a
spoilt, cut off or exchanged file is refused, and a block is all that a task holds.

Tasks write their blocks to a folder of the write's own; the commit moves them into place and then writes the index, the
abort deletes them. So a write that fails, or whose tasks are tried twice, leaves what was there before (a task that outlives
the abort may leave blocks in that folder; no reader looks there). Append adds an index of its own; overwrite removes the
older ones after it. Paths go through pyarrow's file systems: any that it knows, as all tasks see it.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id bigint, features array<float>"
BLOCK_ROWS = 4096


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)


def _indexes(path: str) -> list[str]:
    from pyarrow import fs

    where, base = _at(path)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("index-") and f.base_name.endswith(".json"))


def _read(path: str, name: str) -> bytes:
    where, base = _at(path)
    with where.open_input_stream(posixpath.join(base, name)) as f:
        return f.read()


def _write(path: str, name: str, data: bytes) -> None:
    where, base = _at(path)
    where.create_dir(posixpath.dirname(posixpath.join(base, name)), recursive=True)
    with where.open_output_stream(posixpath.join(base, name)) as f:
        f.write(data)


@dataclass
class Block(InputPartition):
    name: str
    rows: int
    width: int
    sha256: str


@dataclass
class Written(WriterCommitMessage):
    blocks: list


class FeatureReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Block]:
        names = _indexes(self.path)
        if not names:
            raise ValueError(f"{self.path} has no index: it isn't a finished feature folder")
        blocks = [Block(**b) for n in names for b in json.loads(_read(self.path, posixpath.basename(n)))["blocks"]]
        widths = {b.width for b in blocks}
        if len(widths) > 1:
            raise ValueError(f"{self.path} holds features of widths {sorted(widths)}")
        return blocks or [Block("", 0, 0, "")]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.rows:
            return
        data = _read(self.path, block.name)
        if hashlib.sha256(data).hexdigest() != block.sha256:
            raise ValueError(f"{block.name} isn't what its digest tells")
        if len(data) != block.rows * (8 + 4 * block.width):
            raise ValueError(f"{block.name} has not the shape {block.rows} x {block.width}")
        ids, features = np.frombuffer(data, "<i8", block.rows), np.frombuffer(data, "<f4", offset=8 * block.rows)
        offsets = pa.array(np.arange(0, block.rows * block.width + 1, block.width, np.int32) if block.width else np.zeros(block.rows + 1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(features))], names=["id", "features"])


class FeatureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, block_rows: int):
        self.path, self.overwrite, self.block_rows, self.run = path, overwrite, block_rows, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        blocks, width = [], None
        for batch in iterator:
            for at in range(0, batch.num_rows, self.block_rows):
                part = batch.slice(at, self.block_rows)
                ids, vectors = part.column(0), part.column(1)
                if ids.null_count or vectors.null_count or vectors.flatten().null_count:
                    raise ValueError("ids and features can't be null")
                sizes = set(np.diff(vectors.offsets.to_numpy()).tolist()) | ({width} if width is not None else set())
                if len(sizes) != 1:
                    raise ValueError(f"features of widths {sorted(sizes)} make no matrix")
                width = sizes.pop()
                data = ids.to_numpy().astype("<i8").tobytes() + vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                name = f"block-{uuid.uuid4().hex}.bin"
                _write(self.path, f"_writing-{self.run}/{name}", data)
                blocks.append({"name": name, "rows": part.num_rows, "width": width, "sha256": hashlib.sha256(data).hexdigest()})
        return Written(blocks)

    def commit(self, messages: list) -> None:
        where, base = _at(self.path)
        blocks, older = [b for m in messages if m for b in m.blocks], _indexes(self.path)
        if len({b["width"] for b in blocks}) > 1:
            self.abort(messages)
            raise ValueError("tasks wrote features of several widths")
        where.create_dir(base, recursive=True)
        for b in blocks:
            where.move(posixpath.join(base, f"_writing-{self.run}", b["name"]), posixpath.join(base, b["name"]))
        _write(self.path, f"_writing-{self.run}/index.json", json.dumps({"blocks": blocks}).encode())
        gone = [b["name"] for n in older for b in json.loads(_read(self.path, posixpath.basename(n)))["blocks"]] if self.overwrite else []
        where.move(posixpath.join(base, f"_writing-{self.run}/index.json"), posixpath.join(base, f"index-{self.run}.json"))
        for name in ([posixpath.basename(n) for n in older] if self.overwrite else []) + gone:
            where.delete_file(posixpath.join(base, name))
        where.delete_dir(posixpath.join(base, f"_writing-{self.run}"))

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        where, base = _at(self.path)
        mine = posixpath.join(base, f"_writing-{self.run}")
        if where.get_file_info(mine).type != fs.FileType.NotFound:
            where.delete_dir(mine)


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FeatureWriter:
        return FeatureWriter(self.options["path"], overwrite, int(self.options.get("block_rows", BLOCK_ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureSource)
