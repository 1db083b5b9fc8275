"""The table as a Spark format, whole log files, side indexes over changed sources."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from skyquill.sources import companion, maintenance
from skyquill.sources.format import LogTable, Reader, register
from skyquill.sources.table import Table, TableError


@pytest.fixture
def wide(spark):
    return spark.range(300).select(
        "id", F.concat(F.lit("né"), F.col("id")).alias("s"), (F.col("id") % 3).cast("int").alias("p"), F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("id") / 7).alias("d"),
        F.timestamp_micros(F.col("id") * 3_600_000_000).alias("ts"), F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.when(F.col("id") % 10 > 0, F.col("id").cast("decimal(10,2)")).alias("m"), F.array("id", "id").alias("a"),
    ).repartitionByRange(3, "id")


def same(a, b):
    a, b = (x.select(*sorted(x.columns)).withColumn("d", F.col("d").cast("string")) for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("by", [None, "p", "p,day"])
def test_format_round_trip(spark, tmp_path, wide, by):
    register(spark)
    path = f"{tmp_path}/t"
    writer = wide.limit(60).write.format("skyquill").mode("append")
    (writer.option("partitionBy", by) if by else writer).save(path)
    first = spark.read.format("skyquill").load(path)
    assert same(first, wide.limit(60)) and same(Table(spark, f"file://{path}").read(), wide.limit(60))
    wide.filter("id >= 200").write.format("skyquill").mode("append").save(path)
    now = spark.read.format("skyquill").load(path)
    for test in ("id = 205", "p = 1 AND id > 250", "s = 'né7'", "ts < TIMESTAMP '1970-01-02 00:00:00'", "day = DATE '2020-01-05'", "m > 290", "d > 40", "m IS NULL", "p IN (0, 2)", "id <> 5", "p IS NULL"):
        expected = wide.limit(60).union(wide.filter("id >= 200")).filter(test)
        assert sorted(r.id for r in now.filter(test).collect()) == sorted(r.id for r in expected.collect()), test
    assert spark.read.format("skyquill").option("version", 0).load(path).count() == 60
    wide.limit(5).write.format("skyquill").mode("overwrite").save(path)
    assert spark.read.format("skyquill").load(path).count() == 5 and spark.read.format("skyquill").option("version", 1).load(path).count() == 160
    with pytest.raises(Exception, match="missing"):
        wide.drop("s").write.format("skyquill").mode("append").save(path)
    with pytest.raises(Exception, match="no table"):
        spark.read.format("skyquill").load(f"{tmp_path}/none")


def test_pushed_filters_leave_files_out(spark, tmp_path, wide):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    path = f"{tmp_path}/t"
    t = Table(spark, f"file://{path}")
    t.write(wide, partition_by=["p"])
    assert len(LogTable(path).snapshot().files) == 9

    def left(*filters):
        reader = Reader(path, t.snapshot().schema, None)
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark tests all of them again
        return len(reader.partitions())

    assert left() == 9 and left(EqualTo(("p",), 1)) == 3 and left(EqualTo(("p",), 1), GreaterThan(("id",), 250)) == 1 and left(In(("p",), (0, 2))) == 6
    assert left(EqualTo(("day",), datetime.date(2020, 1, 3))) == 3 and left(IsNull(("p",))) == 0 and left(GreaterThan(("d",), 1e9)) == 6  # those with a NaN


def test_checkpoints_are_read_by_the_format(spark, tmp_path, wide):
    register(spark)
    t = Table(spark, f"file://{tmp_path}/t")
    for k in range(12):
        t.write(wide.filter(F.col("id") == k))
    assert t.last_checkpoint() == 10 and spark.read.format("skyquill").load(f"{tmp_path}/t").count() == 12


def test_a_log_file_that_is_not_whole_is_refused(spark, tmp_path, wide):
    path = f"{tmp_path}/t"
    t = Table(spark, f"file://{path}")
    t.write(wide.limit(3))
    with open(f"{path}/_log/{1:020d}.json", "w") as out:
        out.write('{"txn": {"app": "x", "ba')
    with pytest.raises(TableError, match="not whole"):
        Table(spark, f"file://{path}").read()
    os.unlink(f"{path}/_log/{1:020d}.json")
    assert t.write(wide.limit(3)) == 1 and not t.fs.create(t._file(1), "x\\n") and t.fs.create(t._file(7), "x\\n")
    assert not [n for n in os.listdir(f"{path}/_log") if n.startswith(".") and not n.endswith(".crc")]


def test_changed_sources_are_read_again(spark, tmp_path):
    source, index = f"file://{tmp_path}/source", f"file://{tmp_path}/index"
    write = lambda rows, name: (spark.createDataFrame(rows, "id int, body string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one"), os.makedirs(f"{tmp_path}/source", exist_ok=True), os.replace(next(f"{tmp_path}/one/{n}" for n in os.listdir(f"{tmp_path}/one") if n.endswith(".parquet")), f"{tmp_path}/source/{name}"))
    write([(1, "red fox"), (2, "blue whale")], "a+1 é.parquet")
    write([(3, "nothing here")], "b.parquet")
    done = companion.sync(spark, source, index, {"body": "text"}, where="id < 3")
    assert done["added"] == 2 and Table(spark, index).read().count() == 2
    assert companion.sync(spark, source, index, {"body": "text"}, where="id < 3")["added"] == 0  # also the file without rows
    write([(1, "green fox jumps"), (2, "grey whale")], "a+1 é.parquet")
    done = companion.sync(spark, source, index, {"body": "text"}, where="id < 3")
    assert (done["added"], done["removed"], done["kept"]) == (1, 0, 1)
    found = companion.search_index(spark, index, "green OR blue", "body").collect()
    assert [(r.id, r.body) for r in found] == [(1, "green fox jumps")]
    os.unlink(f"{tmp_path}/source/a+1 é.parquet")
    assert companion.sync(spark, source, index, {"body": "text"})["removed"] == 1 and Table(spark, index).read().count() == 0


def test_merges_tell_what_came_of_them(spark, tmp_path, wide, monkeypatch):
    t = Table(spark, f"file://{tmp_path}/t")
    t.write(wide)
    files = sorted(t.snapshot().files)
    assert [r["status"] for r in maintenance.compact(t, precommit=True)] == ["planned"] and len(t.snapshot().files) == 3
    maintenance.skip_file(t, files[0], "odd", hours=24)
    maintenance.skip_file(t, files[1], "odd", hours=-1)
    assert [r["merged"] for r in maintenance.compact(t)] == [2] and t.read().count() == 300
    maintenance.skip_file(t, files[0], "no more", hours=-1)
    write = t._write_files

    def slow(*args):
        out = write(*args)
        Table(spark, t.path).write(wide.limit(1), "overwrite")
        return out

    monkeypatch.setattr(t, "_write_files", slow)
    report = maintenance.compact(t)
    assert [(r["merged"], r["into"], r["status"]) for r in report] == [(0, 0, "another writer came first")] and t.read().count() == 1


def test_write_hooks_sizes_and_statistics(spark, tmp_path, wide):
    t = Table(spark, f"file://{tmp_path}/t")
    t.write(wide.coalesce(1), target_bytes=4000)
    assert len(t.snapshot().files) > 1  # by a sample, as there is no history
    for _ in range(4):
        t.write(wide.limit(10).coalesce(1), merge_above=3, merge_in_background=True)
        t.merging.join()
    assert t.read().count() == 340 and len(t.snapshot().files) <= 3
    t._write_files(wide.limit(1), [])  # never committed
    stray = lambda: len([p for p, *_ in t.fs.files() if p.endswith(".parquet") and p not in t.snapshot().files and p not in t.snapshot().removed])
    assert stray() == 1
    from skyquill.sources import table as module

    seen = []
    kept, maintenance.purge = maintenance.purge, lambda table, *a, **k: seen.append(table.snapshot().version)
    try:
        for _ in range(6):
            t.write(wide.limit(1), purge_every=3)
    finally:
        maintenance.purge = kept
    assert len(seen) == 2 and all(v % 3 == 2 for v in seen) and module.SAMPLED > 0
    stats = {r.column: r for r in t.statistics().collect()}
    assert stats["id"].min == "0" and stats["id"].max == "299" and stats["id"].rows == 346 and stats["m"].nulls > 0 and stats["d"].max is None and stats["a"].min is None


def test_public_names():
    import skyquill

    assert skyquill.Table is Table and all(callable(getattr(skyquill, n)) for n in skyquill.__all__)
    with pytest.raises(AttributeError):
        skyquill.nothing
