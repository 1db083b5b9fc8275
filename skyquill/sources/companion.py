"""Side indexes over external data: a versioned table of tokens and keys beside files that stay where they are.

A sync lists the source's files, finds new and vanished ones by anti-joins with the index's log, tokenizes the new files in
groups (largest first into the emptiest), and commits adds and removes. Rows carry their source file and are joined to nothing:
the stored columns are those asked for, so a search can be answered from the index alone.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.functions.text import exact_hash, extract_pattern, name, strip_pattern, tokens
from skyquill.sources.fs import FileSystem
from skyquill.sources.table import Table, TableError

SOURCE = "__source"
MODES = ("text", "string", "ip", "exact_only", "text_uuid_exactonly", "text_uuid_strip", "text_custom_exactonly", "text_custom_strip")


def list_source(spark: SparkSession, path: str, kind: str = "parquet", options: dict | None = None) -> list[tuple[str, int, int]]:
    """(file, bytes, modified ms) of the source. delta and iceberg need their own jar on the class path; their files never change."""
    if kind == "parquet":
        fs = FileSystem(spark, path)
        return [(p, n, t) for p, n, t in fs.files() if p.endswith(".parquet") and not any(x.startswith(("_", ".")) for x in p.split("/"))]
    if kind in ("delta", "iceberg"):
        files = spark.read.format(kind).options(**(options or {})).load(path).inputFiles()
        return [(f, 0, 0) for f in files]
    raise ValueError(f"unknown source: {kind}")


def apply_modes(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Index columns by mode. exact_only keeps a hash; the uuid and custom modes split identifiers off a text."""
    for column, mode in modes.items():
        mode, _, pattern = mode.partition(":")
        args = (pattern,) if pattern else ()
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; there are: {', '.join(MODES)}")
        if mode == "text":
            df = df.withColumn(f"__tok_{column}", tokens(column))
        elif mode == "exact_only":
            df = df.withColumn(f"__hash_{column}", exact_hash(column))
        elif mode == "ip":
            from skyquill.functions.ip import ip_key

            df = df.withColumn(f"__ip_{column}", ip_key(column))
        elif mode.startswith("text_"):
            if mode.endswith("exactonly"):
                df = df.withColumn(f"__exact_{column}", F.transform(extract_pattern(column, *args), lambda x: F.xxhash64(x)))
            df = df.withColumn(f"__rest_{column}", strip_pattern(column, *args)).withColumn(f"__tok_{column}", tokens(f"__rest_{column}")).drop(f"__rest_{column}")
    return df


def plan_groups(files: list[tuple[str, int]], groups: int) -> list[list[str]]:
    """Largest file first into the emptiest group."""
    loads = [(0, i, []) for i in range(max(1, min(groups, len(files))))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        load, i, own = min(loads)
        own.append(path)
        loads[loads.index((load, i, own))] = (load + max(size, 1), i, own)
    return [own for _, _, own in loads if own]


def sync(spark: SparkSession, source: str, index: str, modes: dict[str, str], kind: str = "parquet", where: str | None = None, max_files_per_commit: int = 100, dry_run: bool = False, columns: list[str] | None = None, exclude: list[str] | None = None, hashed: tuple[str, list[str]] | None = None, schema_source: str | None = None, target_bytes: int | None = None, reader_options: dict | None = None, again: bool = False, config: dict | None = None) -> dict:
    """Brings the index at ``index`` up to date with ``source``. Counts of files added (or changed), removed and kept.

    The log holds size and time of every file that was read, rows or not. A file of another size or time is read again, and its old rows go in the
    commit that adds its new ones. ``columns``: what the index stores beside its own columns, all if not given, without ``exclude``. ``hashed``:
    (INCLUDE or EXCLUDE, columns), the text columns that get a hash column for equality. ``schema_source``: a file whose schema the source is read with.
    ``target_bytes``: source bytes a commit. ``again``: read all files again.
    """
    table = Table(spark, index)
    snap = table.snapshot() if table.exists() else None
    if snap and snap.metadata["config"].get("source") not in (None, source):
        raise TableError(f"the index belongs to {snap.metadata['config']['source']}")
    listed = list_source(spark, source, kind, reader_options)
    known = [(x["path"], x["size"], x["modified"]) for x in snap.sources.values()] if snap else []
    schema, key = "file string, size long, modified long", ["file", "size", "modified"]
    now, done = spark.createDataFrame(listed, schema), spark.createDataFrame(known, schema)
    new = list(listed) if again else [tuple(r) for r in now.join(done, key, "left_anti").collect()]  # files, not rows
    old = {f for f, _, _ in known} if again else {r["file"] for r in done.join(now, key, "left_anti").collect()}
    gone = old - {f for f, _, _ in new}
    out = {"added": len(new), "removed": len(gone), "kept": len(listed) - len(new), "version": snap.version if snap else -1}
    if dry_run:
        return out

    def without(snapshot, files):
        """Actions that take the rows of files out."""
        stamp = int(time.time() * 1000)
        return [*({"remove": {"path": p, "at": stamp}} for p, f in snapshot.files.items() if f["partition"].get(SOURCE) in files), *({"source": {"path": p, "gone": True}} for p in files if p in snapshot.sources)]

    if gone:
        out["version"] = table._commit(lambda now: without(now, gone))
    sizes = {f: (n, t) for f, n, t in new}
    fs = FileSystem(spark, source)
    commits = max(-(-len(new) // max_files_per_commit), -(-sum(n for _, n, _ in new) // target_bytes) if target_bytes else 1)
    given = spark.read.parquet(schema_source).schema if schema_source else None
    for group in plan_groups([(f, n) for f, n, _ in new], commits) if new else []:
        paths = [f if "://" in f or f.startswith("/") else f"{source.rstrip('/')}/{f}" for f in group]
        reader = spark.read.option("basePath", source) if kind == "parquet" else spark.read
        df = (reader.schema(given) if given else reader).parquet(*paths)
        missing = [c for c in [*(columns or ()), *(exclude or ()), *modes, *(hashed[1] if hashed else ())] if c not in df.columns]
        if missing:
            raise TableError(f"columns that the source lacks: {', '.join(missing)}")
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        kept = [c for c in (columns or df.columns) if c not in (exclude or ())]
        df = df.select(*[F.col(name(c)) for c in dict.fromkeys([*kept, *modes])], F.col("_metadata"))
        one = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        names = spark.createDataFrame([(fs.fs.makeQualified(fs.jvm.org.apache.hadoop.fs.Path(p)).toUri().toString() if kind == "parquet" else p, f) for p, f in zip(paths, group)], f"__path string, {SOURCE} string")
        df = df.withColumn("__file", one(F.col("_metadata.file_path"))).join(F.broadcast(names.withColumn("__path", one(F.col("__path")))), F.col("__file") == F.col("__path"))  # max_files_per_commit rows
        df = apply_modes(df.drop("__file", "__path", "_metadata"), modes)
        for c in [c for c in texts if c in df.columns and (c in hashed[1]) == (hashed[0] == "INCLUDE")] if hashed else []:
            df = df.withColumn(f"__hash_{c}", exact_hash(c))
        if where:
            df = df.filter(where)
        seen = [{"source": {"path": f, "size": sizes[f][0], "modified": sizes[f][1]}} for f in group]
        again = set(group) & old
        more = lambda now, again=again, seen=seen: [*without(now, again), *seen]
        out["version"] = table.write(df, partition_by=[SOURCE], write_mode="hash", config={"source": source, "kind": kind, "modes": json.dumps(modes), **(config or {})}, more=more)
    return out


def search_index(spark: SparkSession, index: str, query: str, column: str) -> DataFrame:
    """Rows of the index that match, without tokenizing."""
    from skyquill.operators.search import search
    from skyquill.plans.query_language import FieldSpec

    df = Table(spark, index).read()
    modes = json.loads(Table(spark, index).snapshot().metadata["config"]["modes"])
    specs = {}
    for c, mode in modes.items():
        if f"__tok_{c}" in df.columns:
            specs[c] = FieldSpec("text", token_column=f"__tok_{c}")
        elif mode == "ip":
            specs[c] = FieldSpec("ip", key_column=f"__ip_{c}")
    return search(df, query, column, specs=specs).drop(*[c for c in df.columns if c.startswith("__")])


def exact_in_index(df: DataFrame, column: str, value: str) -> DataFrame:
    """Equality by the stored hash, with the value as residual."""
    return df.filter((F.col(f"__hash_{column}") == F.xxhash64(F.lit(value))) & (F.col(name(column)) == value))
