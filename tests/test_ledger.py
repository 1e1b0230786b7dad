"""Batches are ingested exactly once, and the stored side isn't shuffled."""

import pytest

from assayframe.functions import digests
from assayframe.sources import files
from assayframe.streaming import ingest, ledger

KEYS = ("a", "b")
SCHEMA = "a string, b string, v long"


def _rows(led):
    return sorted((tuple(r) for r in led.rows().collect()), key=repr)


def test_batches_keys_and_nulls(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/t", KEYS, buckets=4)
    assert led.stored() is None and led.batches() == []
    with pytest.raises(LookupError):
        led.rows()
    one = spark.createDataFrame([("x", "1", 5), ("x", "1", 3), ("y", "1", 1), ("n", None, 7), ("n", None, 7)], SCHEMA).repartition(3)
    assert led.add(one, "b1") and _rows(led) == sorted([("x", "1", 3), ("y", "1", 1), ("n", None, 7), ("n", None, 7)], key=repr)
    assert not led.add(one, "b1") and led.rows().count() == 4  # the batch again, null keys too
    two = spark.createDataFrame([("x", "1", 0), ("z", "", 2), ("n", None, 7)], SCHEMA)
    assert led.add(two, "b2") and _rows(led) == sorted([("x", "1", 3), ("y", "1", 1), ("z", "", 2), *[("n", None, 7)] * 3], key=repr)
    assert led.add(two.limit(0), "empty") and led.rows().count() == 6 and led.batches() == ["b1", "b2", "empty"]
    assert not led.add(two, "b2") and led.new(two.filter("b is not null")).count() == 0
    again = ledger.Ledger(spark.newSession(), led.root, KEYS, buckets=4)  # another session knows the stored rows
    assert not again.add(one, "b1") and again.rows().count() == 6
    with pytest.raises(ValueError):
        led.add(two, "../b3")
    with pytest.raises(ValueError):
        led.new(two.withColumnRenamed("v", ledger.DIGEST))


def test_keys_are_told_apart(spark):
    rows = [("a", "b,c"), ("a,b", "c"), ("", "x"), (" ", "x"), ("null", "x"), ("A", "B"), ("a", "B")]
    df = spark.createDataFrame([(*r, 1) for r in rows] * 2, SCHEMA)
    assert digests.once(df, ["a", "b"], "d").count() == len(rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_stored_side_has_no_exchange(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/t", KEYS, buckets=8)
    df = spark.range(5000).selectExpr("cast(id as string) a", "'k' b", "id v")
    led.add(df, "first")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = _plan(led.new(df))
        stored_side = text[text.index("Range (0, 5000") : text.index("Bucketed: true")]  # the batch is the left side, and printed first
        assert "SortMergeJoin" in text and "FileScan" in stored_side and "Exchange" not in stored_side
        assert "ReadSchema: struct<row_digest:binary>" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert led.add(df.withColumn("v", df.v + 1), "second") and led.rows().count() == 5000


def test_large_batches_are_joined_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SMALL_BATCH", 10)
    led = ledger.Ledger(spark, f"file://{tmp_path}/t", KEYS, buckets=3)
    df = spark.range(300).selectExpr("cast(id % 200 as string) a", "if(id % 50 = 7, null, 'k') b", "id v")
    led.add(df.filter("v < 150"), "1")
    led.add(df, "2")
    want = df.filter("b is not null").select("a", "b").distinct().count() + df.filter("b is null and v < 150").count() + df.filter("b is null").count()
    assert led.rows().count() == want


class Crash(RuntimeError):
    pass


@pytest.mark.parametrize("crash_at", [0, 1])
def test_a_crash_between_append_and_commit_changes_nothing(spark, tmp_path, crash_at):
    """The stream dies after a batch is published and before Spark notes it; the restarted stream replays it."""
    schema = ", ".join(f"{k} string" for k in ingest.KEY)
    rows = spark.createDataFrame([(str(i % 5), *["x"] * 8, None if i % 4 == 0 else "t") for i in range(12)], schema)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    led = ingest.activity_ledger(spark, f"file://{tmp_path}/table")
    crashed = []

    def after(number):
        if number == crash_at and not crashed:
            crashed.append(number)
            raise Crash("between append and commit")

    start = lambda: ingest.stream(ingest.activity_stream(spark, f"{tmp_path}/in", rows.schema, 1), led, f"{tmp_path}/checkpoint", after=after)
    with pytest.raises(Exception, match="between append and commit"):
        start().awaitTermination()
    assert f"stream-{crash_at}" in led.batches()
    start().awaitTermination()
    start().awaitTermination()
    nulls = rows.filter("Result_Tag is null").count()
    assert crashed and led.rows().count() == rows.filter("Result_Tag is not null").distinct().count() + nulls


def test_staged_batches_are_never_read(spark, tmp_path, monkeypatch):
    led = ledger.Ledger(spark, f"file://{tmp_path}/t", KEYS, buckets=2)
    df = spark.createDataFrame([("x", "1", 5)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *a: (_ for _ in ()).throw(Crash("before the rename")))
        with pytest.raises(Crash):
            led.add(df, "b")
    assert led.stored() is None and led.add(df, "b") and led.rows().count() == 1


def test_new_rows_of_two_frames(spark):
    schema = ", ".join(f"{k} string" for k in ingest.KEY) + ", extra long, key_digest long"
    row = lambda cid, tag, n: (cid, *["x"] * 8, tag, n, 1)
    rows = spark.createDataFrame([row("1", "a", 2), row("1", "a", 1), row("2", "a", 1), row("3", None, 1), row("3", None, 1)], schema)
    known = spark.createDataFrame([row("2", "a", 9), row("3", None, 9)], schema)
    got = sorted((r.CID, r.extra) for r in ingest.new_rows(rows, known).collect())
    assert got == [("1", 1), ("3", 1), ("3", 1)] and ingest.new_rows(rows, None).columns == rows.columns
