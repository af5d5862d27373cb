"""Keys, global order, insert-if-absent and upsert."""

from __future__ import annotations

import random

import duckdb
import pytest

from salesloom.operators.load import insert_ignore, touched_parts, upsert, upsert_partitioned, write_partitioned
from salesloom.operators.ordering import assign_keys, with_running_sum, with_tile
from tests.conftest import rows


def test_insert_ignore_keeps_old_rows_and_first_copies(spark):
    target = spark.createDataFrame([(1, "old")], "id int, v string")
    source = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, "c")], "id int, v string")
    out = insert_ignore(target, source, ["id"], ["v"])
    assert rows(out, "id") == [(1, "old"), (2, "a"), (3, "c")]
    assert rows(insert_ignore(out, source, ["id"], ["v"]), "id") == rows(out, "id")


def test_upsert_updates_listed_columns_only(spark):
    target = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "id int, v int, made string")
    source = spark.createDataFrame([(2, 21, "z"), (3, 30, "w")], "id int, v int, made string")
    out = upsert(target, source, ["id"], ["v"])
    assert rows(out, "id") == [(1, 10, "x"), (2, 21, "y"), (3, 30, "w")]
    assert rows(upsert(out, source, ["id"], ["v"]), "id") == rows(out, "id")


def test_upsert_can_set_null_and_fills_absent_columns(spark):
    target = spark.createDataFrame([(1, 10, "x")], "id int, v int, made string")
    source = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(upsert(target, source, ["id"], ["v"]), "id") == [(1, None, "x"), (2, 5, None)]


def test_upsert_refuses_duplicate_source_keys(spark):
    target = spark.createDataFrame([(1, 10)], "id int, v int")
    source = spark.createDataFrame([(1, 11), (1, 12)], "id int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        upsert(target, source, ["id"], ["v"]).collect()


def test_upsert_random_against_sql(spark):
    rng = random.Random(7)
    for _ in range(3):
        t = [(k, rng.randint(0, 9), rng.randint(0, 9)) for k in rng.sample(range(40), 20)]
        s = [(k, rng.randint(10, 19), rng.randint(10, 19)) for k in rng.sample(range(40), 20)]
        got = rows(
            upsert(
                spark.createDataFrame(t, "k int, a int, b int"), spark.createDataFrame(s, "k int, a int, b int"), ["k"], ["a"]
            ),
            "k",
        )
        con = duckdb.connect()
        con.execute("CREATE TABLE t (k INT PRIMARY KEY, a INT, b INT)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", t)
        con.executemany("INSERT INTO t VALUES (?, ?, ?) ON CONFLICT (k) DO UPDATE SET a = excluded.a", s)
        assert got == con.execute("SELECT k, a, b FROM t ORDER BY k").fetchall()


def test_keys_are_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(7)
    got = rows(assign_keys(df, ["id"], "key", 11), "key")
    assert got == [(n, i) for n, i in enumerate(sorted(ids), start=11)]


@pytest.mark.parametrize("size", [0, 1, 3, 5, 7, 23, 500])
def test_tiles_and_running_sum_as_sql(spark, size):
    rng = random.Random(size)
    data = [(i, rng.randint(0, 3)) for i in range(size)]  # many ties
    df = spark.createDataFrame(data, "id int, v int").repartition(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, v INT)")
    if data:
        con.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = con.execute("SELECT id, ntile(5) OVER (ORDER BY v, id) FROM t ORDER BY id").fetchall()
    assert rows(with_tile(df, ["v", "id"], 5, "tile").select("id", "tile"), "id") == want
    want = con.execute(
        "SELECT id, CAST(sum(v) OVER (ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS INT), CAST(sum(v) OVER () AS INT) FROM t ORDER BY id"
    ).fetchall()
    got = with_running_sum(df, ["v", "id"], "v", "cum", "all").select("id", "cum", "all")
    assert rows(got, "id") == want


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_partitioned_upsert_leaves_other_partitions_alone(spark, tmp_path):
    schema = "id int, v int, made string, part string"
    target = spark.createDataFrame([(i, i, "old", f"p{i % 4}") for i in range(40)], schema)
    path = tmp_path / "t"
    write_partitioned(target, str(path), "part")
    before = _files(path)
    source = spark.createDataFrame([(1, 100, "new", "p1"), (5, 500, "new", "p1"), (41, 1, "new", "p1"), (99, 9, "new", "p9")], schema)
    for _ in range(2):  # the rerun gives the same table
        upsert_partitioned(spark, str(path), target.schema, source, ["id"], ["v"], "part")
        got = {r.id: (r.v, r.made, r.part) for r in spark.read.schema(target.schema).parquet(str(path)).collect()}
        assert len(got) == 42 and got[1] == (100, "old", "p1") and got[41] == (1, "new", "p1") and got[99] == (9, "new", "p9")
        assert got[2] == (2, "old", "p2")
    after = _files(path)
    assert {f: t for f, t in after.items() if "p1" not in f and "p9" not in f} == {f: t for f, t in before.items() if "p1" not in f}
    assert {f.split("/")[0] for f in after} == {"part=p0", "part=p1", "part=p2", "part=p3", "part=p9"}


def test_only_touched_partitions_are_scanned(spark, tmp_path):
    schema = "id int, v int, part string"
    target = spark.createDataFrame([(i, i, f"p{i % 4}") for i in range(8)], schema)
    write_partitioned(target, str(tmp_path / "t"), "part")
    source = spark.createDataFrame([(1, 1, "p1")], schema)
    stored = spark.read.schema(target.schema).parquet(str(tmp_path / "t"))
    text = touched_parts(stored, source, "part")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text and "= p1)" in text
    refused = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p1")], schema)
    with pytest.raises(Exception, match="duplicate key"):
        upsert_partitioned(spark, str(tmp_path / "t"), target.schema, refused, ["id"], ["v"], "part")
    assert spark.read.schema(target.schema).parquet(str(tmp_path / "t")).count() == 8
