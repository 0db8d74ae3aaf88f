"""Fingerprints that add up and see every change; manifests of files in chunks."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loanloom.operators import parity
from loanloom.sources import sinks

SCHEMA = "a string, b string, x double, n int, d date, t array<int>, raw binary"
ROW = ("a|b", "c", 0.1, 1, None, [1, None], b"\x00")


def prints(df, **options):
    return [tuple(r) for r in parity.table_fingerprint(df, **options).collect()]


def test_texts_of_rows_differ_wherever_values_do(spark):
    rows = [ROW, ("a", "b|c", *ROW[2:]), ("a|b", "~", *ROW[2:]), ("a|b", None, *ROW[2:]), ("a|b", "N", *ROW[2:]), ("a|b", "", *ROW[2:]), ("1:a", "1:c", *ROW[2:]),
            (*ROW[:2], 0.1 + 1e-15, *ROW[3:]), (*ROW[:3], 11, *ROW[4:]), (*ROW[:3], None, *ROW[4:]), (*ROW[:5], [1], b"\x00"), (*ROW[:5], [None, 1], b"\x00"), (*ROW[:6], b"\x00\x00"), (*ROW[:6], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = [r[0] for r in df.select(parity.row_text(df, df.columns)).collect()]
    assert None not in texts and len(set(texts)) == len(rows)
    single = [prints(spark.createDataFrame([r], SCHEMA))[0] for r in rows]
    assert len(set(single)) == len(rows)


def test_prints_ignore_order_and_see_copies(spark):
    df = spark.createDataFrame([ROW, ROW, ("x", None, None, None, None, None, None)], SCHEMA)
    assert prints(df) == prints(df.repartition(3).select(*reversed(df.columns)))
    assert prints(df) != prints(df.distinct())


def test_prints_of_parts_add_up_and_can_be_taken_away(spark):
    df = spark.range(500).selectExpr("cast(id % 5 as string) AS k", "id AS v", "if(id % 7 = 0, null, id / 3) AS x")
    by = lambda d: parity.table_fingerprint(d, ["v", "x"], ["k"])
    whole, part = df, df.filter("v < 200")
    added = parity.combine_prints(by(part).unionByName(by(df.filter("v >= 200"))), by=["k"])
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, by(whole).collect()))
    left = parity.combine_prints(by(whole), by(part), ["k"])
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, by(df.filter("v >= 200")).collect()))
    assert parity.combine_prints(by(whole), by(whole), ["k"]).collect() == []


def test_only_new_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "'x|~' AS s").repartition(3).write.parquet(folder)
    known = [tuple(r) for r in parity.file_prints(spark, f"{folder}/*.parquet").collect()]
    known_df = spark.createDataFrame(known, "file string, size bigint, modified timestamp, n_rows bigint, hash_a string, hash_b string")
    spark.range(100, 130).selectExpr("id", "'x|~' AS s").coalesce(1).write.mode("append").parquet(folder)
    now = parity.file_prints(spark, f"{folder}/*.parquet", known_df)
    plan = now._jdf.queryExecution().optimizedPlan().toString()
    total = parity.combine_prints(now).collect()
    assert [tuple(r) for r in total] == prints(spark.read.parquet(folder))
    assert len(now.collect()) == 4 and plan
    # a lie about a known file stands: it wasn't read again
    lie = known_df.withColumn("hash_a", F.lit("1"))
    assert sum(r["hash_a"] == "1" for r in parity.file_prints(spark, f"{folder}/*.parquet", lie).collect()) == 3


def tree(data, chunk, fan):
    nodes = [hashlib.sha256(data[i:i + chunk]).hexdigest() for i in range(0, max(len(data), 1), chunk)]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i:i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_files_in_chunks(spark, tmp_path, fan):
    sizes = [0, 1, 15, 16, 17, 32, 33, 64, 65, 300]
    data = {f"f{n}.bin": os.urandom(n) for n in sizes}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = sinks.file_manifest(spark, str(tmp_path / "*.bin"), chunk=16, fan=fan)
    assert {r["name"]: (r["size"], r["sha256"]) for r in found.collect()} == {n: (len(c), tree(c, 16, fan)) for n, c in data.items()}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    plain = sinks.file_manifest(spark, str(tmp_path / "*.bin"))
    assert {r["name"]: r["sha256"] for r in plain.collect()} == {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}


def test_one_changed_byte_far_into_a_file_is_found(spark, tmp_path):
    for side, byte in (("here", b"a"), ("there", b"b")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "big.bin").write_bytes(b"0" * 1000 + byte + b"0" * 1000)
        (tmp_path / side / "same.bin").write_bytes(b"1" * 700)
    sides = [sinks.file_manifest(spark, str(tmp_path / s / "*.bin"), chunk=64, fan=4) for s in ("here", "there")]
    got = {r["name"]: (r["action"], r["problem"]) for r in sinks.file_manifest_diff(*sides).collect()}
    assert got == {"big.bin": ("upload", "checksum differs"), "same.bin": ("skip", None)}


def test_files_of_a_skewed_year_follow_its_volume(spark, tmp_path):
    """One year with 95 % of the rows becomes many files of a bounded size, and a small year one file."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr("md5(cast(id as string)) AS v", "if(id % 20 < 19, 1999, cast(2000 + id % 3 as int)) AS source_year")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.sink_parquet_year(rows, str(tmp_path / "years"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    sizes = {}
    for file in (tmp_path / "years").rglob("*.parquet"):
        sizes.setdefault(file.parent.name, []).append(file.stat().st_size)
    large = sizes["source_year=1999"]
    assert len(large) >= 4 and max(large) < 1.6 * min(sum(large) / len(large), 1 << 20)
    assert all(len(v) == 1 for k, v in sizes.items() if k != "source_year=1999")
    assert spark.read.parquet(str(tmp_path / "years")).count() == 200_000
