"""The versioned table as a Spark data source: ``spark.read.format("skyquill").load(path)`` and ``df.write.format("skyquill")``.

``register(spark)`` makes the format known. Reads list the live files of the newest version, or of option ``version``, and leave out those whose
partition values or bounds rule out the filters that Spark pushes; Spark tests all filters again. Each task reads one file, in Arrow batches.
Writes are Parquet files by the tasks, which also take the bounds, and one commit: append, or overwrite as a whole. Option ``partitionBy``
names the partition columns of a new table.

Tasks and the planner have no JVM here, so paths are those that pyarrow opens: local ones, and stores by URI. ``Table`` reads and writes
the same tables through Hadoop's file systems and is the better way for large scans, as Spark's own Parquet reader prunes columns.
"""

from __future__ import annotations

import datetime
import decimal
import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skyquill.functions.text import lower_bound, upper_bound
from skyquill.sources.table import _NULL, _ORDERED, _UNKNOWN, LOG, READER_VERSION, STATS_COLUMNS, WRITER_VERSION, Snapshot, Table, TableError, _of_folder

NAME = "skyquill"
FILE_ROWS = 1 << 20


class ArrowFiles:
    """What the log needs of a file system, without a JVM."""

    def __init__(self, root: str):
        root = root.rstrip("/")
        root = "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root
        self.fs, self.root = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")

    def at(self, relative: str) -> str:
        return f"{self.root}/{relative}" if relative else self.root

    def names(self, relative: str) -> list[str]:
        return sorted(f.base_name for f in self.fs.get_file_info(pafs.FileSelector(self.at(relative), allow_not_found=True)))

    def exists(self, relative: str) -> bool:
        return self.fs.get_file_info(self.at(relative)).type != pafs.FileType.NotFound

    def read(self, relative: str) -> str:
        with self.fs.open_input_stream(self.at(relative)) as stream:
            return stream.read().decode()

    def create(self, relative: str, text: str, overwrite: bool = False) -> bool:
        """False if the file is there. On local disks the whole file appears at once, for one writer; elsewhere the store decides."""
        target = self.at(relative)
        self.fs.create_dir(os.path.dirname(target), recursive=True)
        if isinstance(self.fs, pafs.LocalFileSystem):
            aside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(aside, "x") as out:
                out.write(text)
            try:
                os.link(aside, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        if not overwrite and self.exists(relative):
            return False
        with self.fs.open_output_stream(target) as out:
            out.write(text.encode())
        return True


class LogTable(Table):
    """The log of a table without a session."""

    def __init__(self, path: str):
        self.spark, self.path, self.fs, self._cached = None, path.rstrip("/"), ArrowFiles(path), None

    def _checkpoint_lines(self, version: int) -> list[str]:
        folder = f"{LOG}/{version:020d}.checkpoint"
        return [line for n in self.fs.names(folder) if n.startswith("part-") for line in self.fs.read(f"{folder}/{n}").splitlines()]

    def checkpoint(self) -> int:
        return self.snapshot().version  # left to the next writer with a session

    def _instant(self, value):
        if isinstance(value, datetime.datetime) and value.tzinfo is not None:
            return (value - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)
        return _UNKNOWN


def _triple(f: D.Filter):
    """A filter as (column, operator, value), or None."""
    if isinstance(f, D.Not) and isinstance(f.child, D.EqualTo):
        return ".".join(f.child.attribute), "!=", f.child.value
    if not getattr(f, "attribute", None) or len(f.attribute) > 1:
        return None
    column = f.attribute[0]
    for kind, op in ((D.EqualTo, "="), (D.LessThan, "<"), (D.LessThanOrEqual, "<="), (D.GreaterThan, ">"), (D.GreaterThanOrEqual, ">=")):
        if type(f) is kind:
            return column, op, f.value
    if type(f) is D.In:
        return column, "in", list(f.value)
    if type(f) is D.IsNull:
        return column, "is null", None
    if type(f) is D.IsNotNull:
        return column, "is not null", None
    return None


@dataclass
class File(D.InputPartition):
    path: str
    partition: dict

    def __init__(self, path: str, partition: dict):
        super().__init__(None)
        self.path, self.partition = path, partition


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, version: int | None):
        self.path, self.schema, self.version, self.filters = path, schema, version, []

    def pushFilters(self, filters):
        for f in filters:
            triple = _triple(f)
            if triple and not (triple[1] != "is null" and triple[1] != "is not null" and triple[2] is None):
                self.filters.append(triple)
            yield f

    def partitions(self) -> list[File]:
        table = LogTable(self.path)
        snap = table.snapshot(self.version)
        files, _ = table._prune(snap, self.filters)
        root = snap.metadata["config"].get("table_root", self.path)
        return [File(f"{root}/{f['path']}", f["partition"]) for f in files]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        wanted = to_arrow_schema(self.schema)
        kinds = {f.name: f.dataType for f in self.schema.fields}
        folder, _, name = partition.path.rpartition("/")
        files = ArrowFiles(folder)
        with files.fs.open_input_file(files.at(name)) as source:
            found = pq.ParquetFile(source)
            there = set(found.schema_arrow.names)
            for batch in found.iter_batches(columns=[n for n in wanted.names if n in there]):
                columns = []
                for field in wanted:
                    if field.name in there:
                        columns.append(batch.column(batch.schema.get_field_index(field.name)).cast(field.type))
                        continue
                    value = _of_folder(kinds[field.name], partition.partition.get(field.name))
                    value = partition.partition.get(field.name) if value is _UNKNOWN else value
                    if isinstance(kinds[field.name], T.DateType) and isinstance(value, int):
                        value = datetime.date(1970, 1, 1) + datetime.timedelta(days=value)
                    scalar = pa.scalar(value, pa.string()).cast(field.type) if isinstance(value, str) else pa.scalar(value, field.type)
                    columns.append(pa.repeat(scalar, batch.num_rows))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(wanted)))


@dataclass
class Written(D.WriterCommitMessage):
    adds: list


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, partition_by: list[str] | None):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        table = LogTable(path)
        self.partition_by = partition_by or []
        if table.exists():
            snap = table.snapshot()
            if snap.metadata and not (overwrite and partition_by is not None):
                self.partition_by = snap.partition_by
            if not overwrite:
                Table._check(_Columns(schema), snap)
        missing = [c for c in self.partition_by if c not in schema.names]
        if missing:
            raise TableError(f"partition columns that are not there: {', '.join(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, token, writers = ArrowFiles(self.path), uuid.uuid4().hex, {}
        data = [n for n in self.schema.names if n not in self.partition_by]
        for batch in iterator:
            for key, part in self._parts(batch):
                if key not in writers:
                    folder = "/".join(f"{urllib.parse.quote(c, safe='')}={_NULL if v is None else urllib.parse.quote(v, safe='')}" for c, v in zip(self.partition_by, key))
                    relative = f"{folder}/{token}-{len(writers)}.parquet" if folder else f"{token}-{len(writers)}.parquet"
                    files.fs.create_dir(os.path.dirname(files.at(relative)), recursive=True)
                    writers[key] = (relative, pq.ParquetWriter(files.fs.open_output_stream(files.at(relative)), part.select(data).schema), _Bounds(self.schema, data))
                writers[key][1].write_batch(part.select(data))
                writers[key][2].add(part)
        adds = []
        for key, (relative, writer, bounds) in writers.items():
            writer.close()
            adds.append({"path": relative, "size": files.fs.get_file_info(files.at(relative)).size, "modified": int(time.time() * 1000), "partition": dict(zip(self.partition_by, key)), "stats": bounds.stats()})
        return Written(adds)

    def _parts(self, batch: pa.RecordBatch):
        """(partition values as text, rows)."""
        if not self.partition_by:
            return [((), batch)]
        table = pa.Table.from_batches([batch])
        keys = table.select(self.partition_by)
        out = []
        for row in keys.group_by(self.partition_by).aggregate([]).to_pylist():
            mask = None
            for c in self.partition_by:
                same = pc.is_null(keys[c]) if row[c] is None else pc.fill_null(pc.equal(keys[c], pa.scalar(row[c], keys[c].type)), False)
                mask = same if mask is None else pc.and_(mask, same)
            text = tuple(None if row[c] is None else str(row[c]).lower() if isinstance(row[c], bool) else str(row[c]) for c in self.partition_by)
            out += [(text, b) for b in table.filter(mask).to_batches()]
        return out

    def commit(self, messages) -> None:
        adds = [a for m in messages if m for a in m.adds]
        metadata = {"schema": json.loads(self.schema.json()), "partition_by": self.partition_by, "config": {}}

        def make(now: Snapshot):
            out = [{"protocol": {"reader": READER_VERSION, "writer": WRITER_VERSION}}] if now.version < 0 else []
            if now.metadata is None or self.overwrite:
                out.append({"metadata": metadata | {"config": (now.metadata or metadata)["config"]}})
            if self.overwrite:
                out += [{"remove": {"path": p, "at": int(time.time() * 1000)}} for p in now.files]
            return [*out, *({"add": a} for a in adds)]

        LogTable(self.path)._commit(make)

    def abort(self, messages) -> None:
        files = ArrowFiles(self.path)
        for m in messages:
            for a in m.adds if m else []:
                files.fs.delete_file(files.at(a["path"]))


class _Columns:
    """A schema where a frame is asked for."""

    def __init__(self, schema: T.StructType):
        self.schema, self.columns = schema, schema.names


class _Bounds:
    """Rows, nulls, minima and maxima over batches, as Table keeps them."""

    def __init__(self, schema: T.StructType, data: list[str]):
        self.kinds = {f.name: f.dataType for f in schema.fields if f.name in data and isinstance(f.dataType, _ORDERED)}
        self.kinds = dict(list(self.kinds.items())[:STATS_COLUMNS])
        self.rows, self.nulls, self.low, self.high, self.odd = 0, dict.fromkeys(self.kinds, 0), {}, {}, set()

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        for c, kind in self.kinds.items():
            column = batch.column(batch.schema.get_field_index(c))
            self.nulls[c] += column.null_count
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                column = column.cast(pa.float64())
                if pc.any(pc.fill_null(pc.is_nan(column), False)).as_py():
                    self.odd.add(c)  # NaN is above all numbers
                column = column.filter(pc.fill_null(pc.is_finite(column), False)) if not pc.all(pc.fill_null(pc.is_finite(column), True)).as_py() and not self.odd.add(c) else column
            if column.null_count == len(column):
                continue
            if isinstance(kind, T.TimestampType):
                column = column.cast(pa.int64())
            elif isinstance(kind, T.DateType):
                column = column.cast(pa.int32())
            found = pc.min_max(column).as_py()
            self.low[c] = found["min"] if c not in self.low else min(self.low[c], found["min"])
            self.high[c] = found["max"] if c not in self.high else max(self.high[c], found["max"])

    def stats(self) -> dict:
        plain = lambda v: str(v) if isinstance(v, decimal.Decimal) else v
        low = {c: lower_bound(v) if isinstance(v, str) else plain(v) for c, v in self.low.items() if c not in self.odd}
        high = {c: upper_bound(v) if isinstance(v, str) else plain(v) for c, v in self.high.items() if c not in self.odd}
        return {"rows": self.rows, "min": low, "max": {c: v for c, v in high.items() if v is not None}, "nulls": self.nulls}


class Source(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise TableError("a path is needed")
        return path

    def _version(self) -> int | None:
        return int(self.options["version"]) if self.options.get("version") else None

    def schema(self) -> T.StructType:
        table = LogTable(self._path())
        if not table.exists():
            raise TableError(f"no table at {self._path()}")
        return table.snapshot(self._version()).schema

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._path(), schema, self._version())

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        by = self.options.get("partitionBy")
        return Writer(self._path(), schema, overwrite, [c.strip() for c in by.split(",") if c.strip()] if by is not None else None)


def register(spark: SparkSession) -> None:
    """Makes the format known in the session and turns on the pushing of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
