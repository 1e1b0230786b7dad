"""What the findings of round 4 were about."""

import io

import pytest
from pyspark.sql import functions as F

from assayframe.plans import queries
from assayframe.sources import readers, writers


def _listed_by_driver(spark):
    """How many files Spark's driver has listed so far."""
    return spark.sparkContext._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED().getCount()


def test_landed_assays_arent_listed_by_the_driver(spark, tmp_path):
    n = 400
    kinds = F.array(*[F.lit(k) for k in ("purchase", "click", "view", "error", "other")])
    id_ = F.col("id")
    events = spark.range(0, n * 50, 1, 2).select(id_.alias("event_id"), (id_ % 7).alias("user_id"), kinds[(id_ % 5).cast("int")].alias("event_type"), (id_ / 8).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    before = _listed_by_driver(spark)
    told = queries.assay_files(spark, str(tmp_path))
    assert told.select("AID").distinct().count() == n and told.count() == n * 11 * 8
    assert _listed_by_driver(spark) - before < n


def test_headers_arent_broadcast(spark, tmp_path):
    (tmp_path / "aid_7.csv").write_text("a,b\n1,2\n")
    plan = readers.assay_cells(spark, f"file://{tmp_path}/*.csv")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_written_files_hold_their_lines_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "y"), ("a", 10, "é"), ("b", -1, "x\nz"), ("a", 9, "")], "n string, at long, line string").repartition(3)
    files = writers.write_files(rows, f"file://{tmp_path}/made", F.col("n"), F.concat(F.lit("head "), "n"), F.col("line"), F.col("at"))
    got = {r.file.rpartition("/")[2]: (open(r.file.removeprefix("file://"), "rb").read(), r.bytes) for r in files.collect()}
    assert got == {"a": ("head a\n\né\n".encode(), 11), "b": (b"head b\nx\nz\ny\n", 13)}
    assert writers.write_files(rows.limit(0), f"file://{tmp_path}/none", F.col("n"), F.col("n"), F.col("line"), F.col("at")).count() == 0


ODD = ["", "\n", "a", "a,b\n1,2", "a,b\r\n1,2\r\n", "\n\n\n", 'a,b\n"x\ny",2\n"",\n', '"a""\n",b\n\n3,"\n\n\n"\n4,5,6\n7\n', "\ufeffa,b\n1,2\n", "é" * 40 + ",b\n" + "ü," * 30 + "\n", 'k\n"' + "line\n" * 30 + '"\n8\n']


@pytest.mark.parametrize("block", [23, 64, 1000])
def test_listed_files_are_read_like_a_path(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(readers, "BLOCK", block)
    monkeypatch.setattr(readers, "OPEN", 0)  # or there would be a task for each few bytes
    for k, text in enumerate(ODD):
        (tmp_path / f"aid_{k}.csv").write_bytes(text.encode())
    sizes = [(f"file://{p}", p.stat().st_size) for p in tmp_path.glob("*.csv")]
    listed = spark.createDataFrame(sizes, "file string, bytes long")
    told = lambda files: sorted((r.file.rpartition("/")[2], r.record_no, r.value) for r in readers.records(spark, files).collect())
    assert told(listed) == told(f"file://{tmp_path}/*.csv")


@pytest.mark.parametrize("piece", [3, 4, 5, 1 << 20])
@pytest.mark.parametrize("text", ODD)
def test_blocks_hold_the_lines_that_begin_in_them(monkeypatch, piece, text):
    monkeypatch.setattr(readers, "PIECE", piece)
    data, expected, at = text.encode(), [], 0
    for line in data.removesuffix(b"\n").split(b"\n") if data else []:
        expected.append((at, line.removeprefix(readers.BOM)))
        at += len(line) + 1
    for step in (1, 2, 3, 7, 64):
        got = [(b, line) for b in range(0, len(data), step) for p in readers._pieces(io.BytesIO(data), b, min(step, len(data) - b)) for line in p.split(b"\n")]
        assert got == [(at // step * step, line) for at, line in expected]


@pytest.mark.parametrize("step", [150_000, 200_001, 200_002])
def test_a_line_may_be_longer_than_a_piece(step):
    data = b"x" * 200_000 + b"\n" + b"y" * 200_000
    got = [(b, p) for b in range(0, len(data), step) for p in readers._pieces(io.BytesIO(data), b, min(step, len(data) - b))]
    assert got == [(0, b"x" * 200_000), (200_001 // step * step, b"y" * 200_000)]
