import pytest
from pyspark.sql import functions as F

from skyquill.functions import buckets
from skyquill.functions.ip import ip_key, range_of
from skyquill.functions.stem import stem
from skyquill.functions.text import exact_equals, exact_hash, extract_pattern, lenient_json, lower_bound, parse_size, strip_pattern, tokens, upper_bound


def test_tokenizers(spark):
    df = spark.createDataFrame([("Hello, Wörld-2 user@x.com",)], "t string")
    assert df.select(tokens("t")).first()[0] == ["hello", "wörld", "2", "user", "x", "com"]
    assert df.select(tokens("t", "whitespace")).first()[0] == ["Hello,", "Wörld-2", "user@x.com"]
    assert df.select(tokens("t", "raw")).first()[0] == ["Hello, Wörld-2 user@x.com"]
    assert spark.createDataFrame([("a" * 300 + " b",)], "t string").select(tokens("t")).first()[0] == ["b"]


def test_stems():
    pairs = {"running": "run", "flies": "fli", "generously": "generous", "happiness": "happi", "relational": "relat", "skies": "sky", "caresses": "caress", "hopping": "hop", "national": "nation", "consignment": "consign"}
    assert {w: stem(w) for w in pairs} == pairs


def test_histograms(spark):
    df = spark.createDataFrame([(float(d), f"s{i % 2}") for i, d in enumerate([-4, 3, 8, 11, 12, 29, 30, 61, 62, 63])], "depth double, site string")
    assert {r.bucket: r.doc_count for r in buckets.bucket_counts(df, buckets.histogram("depth", 12)).collect()} == {-12.0: 1, 0.0: 3, 12.0: 1, 24.0: 2, 60.0: 3}
    filled = buckets.fill_histogram(buckets.bucket_counts(df, buckets.histogram("depth", 12)), 12)
    assert {r.bucket: r.doc_count for r in filled.collect()} == {-12.0: 1, 0.0: 3, 12.0: 1, 24.0: 2, 36.0: 0, 48.0: 0, 60.0: 3}
    assert {r.bucket for r in buckets.bucket_counts(df, buckets.histogram("depth", 12, 5)).collect()} == {-7.0, 5.0, 29.0, 53.0}
    zones = buckets.range_bucket("depth", ("shore", None, 8), ("shelf", 8, 30), ("slope", 30, 62))
    assert {r.bucket: r.doc_count for r in buckets.bucket_counts(df, zones).collect()} == {"shore": 2, "shelf": 4, "slope": 2}  # 62 and 63 are in no range
    for bad in [lambda: buckets.histogram("p", 0), lambda: buckets.range_bucket("p"), lambda: buckets.range_bucket("p", ("a", 1, 5), ("b", 4, 6)), lambda: buckets.range_bucket("p", ("a", None, None)), lambda: buckets.date_histogram("t", "1y")]:
        with pytest.raises(ValueError):
            bad()


def test_date_histogram(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 10:00:00'), (TIMESTAMP '2024-01-01 10:14:59'), (TIMESTAMP '2024-01-01 10:15:00'), (TIMESTAMP '1969-12-31 23:50:00'), (NULL) AS t(ts)")
    got = {str(r.bucket): r.doc_count for r in buckets.bucket_counts(df, buckets.date_histogram("ts", "15m")).collect()}
    assert got == {"2024-01-01 10:00:00": 2, "2024-01-01 10:15:00": 1, "1969-12-31 23:45:00": 1}
    buckets.register(spark)
    df.createOrReplaceTempView("times")
    assert spark.sql("SELECT sq_date_histogram(ts, 900000000) AS b, count(*) AS n FROM times WHERE ts IS NOT NULL GROUP BY 1").count() == 3


def test_ip_keys(spark):
    df = spark.createDataFrame([("9.0.0.1",), ("10.0.0.1",), ("::1",), ("bad",), (None,)], "a string")
    rows = df.select("a", ip_key("a").alias("k"), ip_key("a", v4_only=True).alias("v4")).collect()
    keys = {r.a: r.k for r in rows}
    assert keys["9.0.0.1"] < keys["10.0.0.1"] and keys["::1"] < keys["9.0.0.1"] and keys["bad"] is None
    assert all(r.v4 == r.k for r in rows if r.a in ("9.0.0.1", "10.0.0.1", "bad"))
    assert range_of("10.0.0.0/30")[1] - range_of("10.0.0.0/30")[0] == 3


def test_compact_forms(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(f"call {u} done", "{\"a\": 1}"), (None, "oops")], "t string, j string").withColumn("h", exact_hash("t"))
    assert df.select(strip_pattern("t"), extract_pattern("t")).first()[:] == ("call  done", [u])
    assert df.filter(exact_equals("t", "h", f"call {u} done")).count() == 1
    got = [r[0] for r in df.select(F.to_json(lenient_json("j"))).collect()]
    assert got[0] == '{"a":1}' and "oops" in got[1]
    assert parse_size("100M") == 100 << 20 and parse_size("5G") == 5 << 30 and parse_size("7") == 7
    with pytest.raises(ValueError):
        parse_size("x")
    assert upper_bound("a" * 40) > "a" * 40 and lower_bound("a" * 40) <= "a" * 40 and upper_bound("b") == "b"
