"""Datasets of named splits as a Spark data source: landed folders stand for a hub.

    spark.dataSource.register(Hub)
    rows.write.format("hub").mode("append").option("split", "test").save(path)
    spark.read.format("hub").schema("subject string, answer int").load(path).where("split = 'test' and subject = 'law'")

A dataset is a folder of Parquet files and manifests manifest-1.json, manifest-2.json, ...; the newest says which files there are, of
which split, with how many rows, and between what values of the column `by`. A read is planned from it: a partition for each file
that the pushed filters leave, and of a file only the schema's columns are read, and only the rows that pass. A write is in two
phases: tasks put files beside the others, where no manifest names them, and say so; the commit writes the next manifest in one step.
So a write that is stopped, or tasks that ran twice, leave nothing that a reader sees, and an aborted one takes its files away.

Two writers at a time: the second to commit finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

SPLIT = "split"


def _open(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def manifest(path: str) -> tuple[int, list[dict]]:
    """The newest manifest's number and files; 0 and none where there is no dataset yet."""
    fs, root = _open(path)
    found = fs.get_file_info(pf.FileSelector(root, allow_not_found=True))
    numbers = [int(f.base_name[9:-5]) for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json")]
    if not numbers:
        return 0, []
    with fs.open_input_stream(f"{root}/manifest-{max(numbers)}.json") as f:
        return max(numbers), json.loads(f.read())


@dataclass
class File(InputPartition):
    name: str
    split: str


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class HubReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership are taken; what is not is left to Spark."""
        names = {f.name for f in self.schema.fields}
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if column in names and all(isinstance(v, str | int) for v in values):
                self.wanted.append((column, values))
            else:
                yield f

    def partitions(self) -> list[File]:
        keep = []
        for f in manifest(self.path)[1]:
            inside = lambda c, vs, f=f: f["split"] in vs if c == SPLIT else c != f["by"] or f["low"] is None or any(f["low"] <= v <= f["high"] for v in vs)
            if f["rows"] and all(inside(c, vs) for c, vs in self.wanted):
                keep.append(File(f["file"], f["split"]))
        return keep or [File("", "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _open(self.path)
        passes = None
        for column, values in self.wanted:
            if column != SPLIT:
                one = pc.field(column).isin(values)
                passes = one if passes is None else passes & one
        want = to_arrow_schema(self.schema)
        source = ds.dataset(f"{root}/{partition.name}", filesystem=fs, format="parquet")
        held = [n for n in want.names if n in source.schema.names and n != SPLIT]
        for batch in source.to_batches(columns=held, filter=passes):
            if batch.num_rows or not held:
                columns = [
                    batch.column(f.name).cast(f.type) if f.name in held else pa.array([partition.split] * batch.num_rows, f.type) if f.name == SPLIT
                    else pa.nulls(batch.num_rows, f.type) for f in want
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


class HubWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split: str, by: str, overwrite: bool) -> None:
        self.path, self.split, self.by, self.overwrite = path, split, by, overwrite
        self.base, self.job = manifest(path)[0], uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, writer, rows, low, high = f"{self.split}-{self.job}-{uuid.uuid4().hex}.parquet", None, 0, None, None
        try:
            for batch in batches:
                writer = writer or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                rows += batch.num_rows
                if self.by in batch.schema.names and batch.num_rows:
                    ends = pc.min_max(batch.column(self.by))
                    low, high = (x for x in ([v for v in (low, ends["min"].as_py()) if v is not None], [v for v in (high, ends["max"].as_py()) if v is not None]))
                    low, high = min(low, default=None), max(high, default=None)
        finally:
            if writer:
                writer.close()
        return Written([{"file": name, "split": self.split, "rows": rows, "by": self.by, "low": low, "high": high}] if writer else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        before = manifest(self.path)
        if before[0] != self.base:
            self.abort(messages)
            raise RuntimeError(f"manifest {before[0]} was written meanwhile")
        kept = [f for f in before[1] if not (self.overwrite and f["split"] == self.split)]
        fs.create_dir(root, recursive=True)
        staged = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as f:
            f.write(json.dumps(kept + [x for m in messages if m for x in m.files]).encode())
        fs.move(staged, f"{root}/manifest-{self.base + 1}.json")

    def abort(self, messages: list[Written | None]) -> None:
        # not only whole files, of which messages tell: tasks that failed have left parts of some
        fs, root = _open(self.path)
        for f in fs.get_file_info(pf.FileSelector(root, allow_not_found=True)):
            if f"-{self.job}-" in f.base_name:
                fs.delete_file(f.path)


class Hub(DataSource):
    """Options: path; split (writes, "train" if not given); by (writes: the column whose least and greatest values each file has noted)."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> StructType:
        files = manifest(self.options["path"])[1]
        if not files:
            raise ValueError(f"no dataset in {self.options['path']}")
        fs, root = _open(self.options["path"])
        from pyspark.sql.pandas.types import from_arrow_schema

        held = from_arrow_schema(pq.read_schema(f"{root}/{files[0]['file']}", filesystem=fs))
        return StructType([*held.fields, StructField(SPLIT, StringType())])

    def reader(self, schema: StructType) -> HubReader:
        return HubReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> HubWriter:
        return HubWriter(self.options["path"], self.options.get("split", "train"), self.options.get("by", ""), overwrite)
