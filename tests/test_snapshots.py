"""Updates rewrite the buckets they touch and nothing else; what fails leaves the table as it was."""

import os

import pytest

from assayframe.operators import merge
from assayframe.sources import files, snapshots

CACHE = "PubChem_CID string, status string, fetched_at string, error_message string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(str(i), "success", "t0", None) for i in range(200)] + [(None, "success", "t0", None)] * 5
    snap = snapshots.Snapshot(spark, f"file://{tmp_path}/t", "PubChem_CID", buckets=16)
    snap.create(spark.createDataFrame(rows, CACHE).repartition(3))
    return snap, rows, str(tmp_path)


def _upsert(rows, updates):
    return merge.upsert_cache(rows, updates, "t1")


def test_only_touched_buckets_are_rewritten(spark, table):
    snap, rows, root = table
    before = _files(root)
    old = snap.manifest()
    updates = spark.createDataFrame([("7", "success", None, "C"), ("new", "success", None, "N"), ("9", "failed", "gone", None)], "PubChem_CID string, status string, error_message string, Formula string")
    assert snap.update(updates, _upsert) == 2 and snap.versions() == [1, 2]
    whole = _upsert(spark.createDataFrame(rows, CACHE), updates)
    assert _rows(snap.read()) == _rows(whole) and snap.read().columns == whole.columns  # with the added column
    assert _rows(snap.read(1)) == sorted(rows, key=repr)
    assert before.items() <= _files(root).items()  # no file was changed or removed
    new = snap.manifest()
    changed = {b for b in new["files"] if new["files"][b] != old["files"].get(b)}
    assert 1 <= len(changed) <= 3 and new["files"]["-1"] == old["files"]["-1"]


def test_what_fails_leaves_the_table_as_it_was(spark, table, monkeypatch):
    snap, rows, _ = table
    updates = spark.createDataFrame([("7", "success", None)], "PubChem_CID string, status string, error_message string")

    def broken(rows, updates):
        raise RuntimeError("no merge")

    with pytest.raises(RuntimeError, match="no merge"):
        snap.update(updates, broken)
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("before the rename")))
        with pytest.raises(RuntimeError, match="before the rename"):
            snap.update(updates, _upsert)
    assert snap.versions() == [1] and _rows(snap.read()) == sorted(rows, key=repr)
    assert snap.update(updates, _upsert) == 2


def test_two_updates_at_once(spark, table):
    snap, _, _ = table
    updates = spark.createDataFrame([("7", "success", None)], "PubChem_CID string, status string, error_message string")

    def slow(rows, updates):
        if snap.versions() == [1]:
            snap.update(updates, _upsert)
        return _upsert(rows, updates)

    with pytest.raises(snapshots.Conflict):
        snap.update(updates, slow)
    assert snap.versions() == [1, 2] and snap.read().filter("fetched_at = 't1'").count() == 1


def test_keys_nulls_and_empty_tables(spark, table, tmp_path):
    snap, rows, _ = table
    updates = spark.createDataFrame([(None, "failed", "odd")], "PubChem_CID string, status string, error_message string")
    snap.update(updates, _upsert)
    assert snap.read().count() == len(rows) + 1 and snap.read().filter("PubChem_CID is null").count() == 6
    snap.update(updates.limit(0), _upsert)
    assert snap.read().count() == len(rows) + 1
    with pytest.raises(ValueError):
        snap.create(spark.createDataFrame(rows, CACHE))
    other = snapshots.Snapshot(spark, f"file://{tmp_path}/other", "k")
    with pytest.raises(LookupError):
        other.read()
    other.create(spark.createDataFrame([], "k string, bucket string"))
    assert other.read().collect() == [] and other.read().columns == ["k", "bucket"]
    other.update(spark.createDataFrame([("a", "x")], "k string, bucket string"), lambda rows, new: rows.unionByName(new))
    assert _rows(other.read()) == [("a", "x")]
