"""What the findings of round 3 were about."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from assayframe.plans.oracle import ORACLE_SQL
from assayframe.plans.queries import QUERIES


def _conflicting(folder):
    """Tables in which every structure is both active and inactive, so that no row is created."""
    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT 17::BIGINT AS p_partkey, 'red ring' AS p_name, 'Brand#1' AS p_brand, 'TIN' AS p_type, 10 AS p_size, 9.5::DOUBLE AS p_retailprice")
    con.sql("""CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, 17::BIGINT AS l_partkey, k::BIGINT AS l_suppkey, k::INT AS l_linenumber, 1.0::DOUBLE AS l_quantity, 1000.0::DOUBLE AS l_extendedprice,
        0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus FROM range(1, 3) r(k)""")
    for t in ("part", "lineitem"):
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["consolidate_invariants", "consolidate_metrics", "metrics_json"])
def test_counters_of_nothing_created_are_zero(spark, tmp_path, name):
    con = _conflicting(tmp_path)
    told = QUERIES[name](spark, str(tmp_path))
    expected = con.sql(f"SELECT {', '.join(told.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    assert text(told.collect()) == text(expected)
    assert not any(v is None for v in expected[0])


def test_identity_is_over_the_sorted_rows(spark):
    import hashlib
    from collections import Counter

    from assayframe.operators import identity

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(f"c{k % 7000}", f"a{k % 3}") for k in range(9000)]
    buckets = {}
    for d, n in sorted(Counter(sha(f'{{"x":"{x}","y":"{y}"}}') for x, y in rows).items()):
        buckets.setdefault(d[:3], []).append(f"{d}:{n}")
    expected = sha("m\n" + ",".join(sha(",".join(b)) for _, b in sorted(buckets.items())))
    df = spark.createDataFrame(rows, "x string, y string")
    for one in (df, df.repartition(7)):
        assert tuple(identity.data_identity(one, ["x", "y"], "m").first()) == (expected, 9000)
    assert identity.data_identity(df.limit(0), ["x", "y"], "m").first().rows == 0


@pytest.mark.parametrize("how", ["merge_by_key", "upsert_cache"])
def test_merges_shuffle_by_key_and_salt(spark, how):
    from assayframe.operators import merge

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = spark.createDataFrame([("1", "success", "t", None, "a")], "PubChem_CID string, status string, fetched_at string, error_message string, x string")
        rows = spark.createDataFrame([("1",), (None,)] * 20, "k string")
        out = merge.merge_cache(rows, cache, "k") if how == "merge_by_key" else merge.upsert_cache(cache, cache, "t1")
        out.collect()
        join = re.search(r"SortMergeJoin \[([^\]]*)\], \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "salt" in join[1] and "update_salt" in join[2]


def test_streamed_files_are_of_equal_size(spark, tmp_path, monkeypatch):
    from assayframe.plans import queries

    monkeypatch.setattr(queries, "shared_path", lambda _, name: f"file://{tmp_path}/{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        queries.incremental_ingest(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["n"] for r in spark.read.parquet(f"file://{tmp_path}/activity-files").groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_clean_knows_all_white_space_without_a_pattern(spark):
    from assayframe.functions import text

    white = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    rows = [(f"{w}a{w}b{w}{w}",) for w in white] + [(None,), ("",), (" \n",), ("é",)]
    out = spark.createDataFrame(rows, "x string").select("x", text.clean("x").alias("clean"), F.regexp_replace(F.coalesce("x", F.lit("")), r"(?U)^\s+|\s+$", "").alias("pattern"))
    assert all(r.clean == r.pattern for r in out.collect())
    plan = out.select("clean")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "trim" in plan
    finite = spark.createDataFrame([(1.0,), (-0.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(text.is_finite(F.col("x")).alias("f"))
    assert [r.f for r in finite.collect()] == [True, True, False, False, False, False]


def test_refusals_make_the_links_once(spark, monkeypatch):
    from assayframe.operators import identity
    from assayframe.plans import queries

    plans, real = [], identity.data_identity

    def told(df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *more)

    monkeypatch.setattr(identity, "data_identity", told)
    queries.refusals(spark, "/root/testdata/sf0.001")
    assert len(plans) > 4 and not any("Join" in p for p in plans)


def test_ragged_files_are_opened_once(spark, tmp_path):
    from assayframe.sources import readers

    (tmp_path / "aid_7.csv").write_text('a,b\n1,"x\ny"\n2,3\n')
    out = readers.assay_cells(spark, f"file://{tmp_path}/*.csv")
    got = sorted((r.AID, r.row_no, r.pos, r.column, r.value) for r in out.collect())
    assert got == [("7", 0, 0, "a", "1"), ("7", 0, 1, "b", "x\ny"), ("7", 1, 0, "a", "2"), ("7", 1, 1, "b", "3")]
    assert "FileScan text" not in out._jdf.queryExecution().executedPlan().toString()


def test_links_of_distinct_pairs_are_not_gathered(spark):
    from assayframe.operators import links

    aids = spark.createDataFrame([("P1", "1"), ("P1", "1"), ("P2", "1"), (None, "2"), ("P3", None)], "Protein string, AID string")
    cids = spark.createDataFrame([("1", "10"), ("1", "10"), ("1", None), ("2", "20"), (None, "30"), ("9", "90")], "AID string, CID string")
    out = links.expand(aids, cids)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("10", "1", "P1"), (None, "1", "P1"), ("10", "1", "P2"), (None, "1", "P2"), ("20", "2", None)]))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "CID" not in "".join(re.findall(r"keys=\[[^\]]*Protein[^\]]*\]", text)) and "REPARTITION_BY_NUM" in text


def test_inserts_of_whole_keys_sort_nothing(spark):
    from assayframe.operators import merge

    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", None), ("1", None), ("2", "b")], "x string, y string")
    out = merge.insert_ignore(df.limit(0), df, ["x", "y"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("1", "a"), ("1", None), ("1", None), ("2", "b")]))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_cells_are_gone_through_in_tiles(monkeypatch):
    import tracemalloc

    import numpy as np

    from assayframe.operators import neighbours as n

    def found(rows):
        words = np.random.default_rng(1).integers(0, 2**12, (rows, 1), np.uint64)  # many ties
        side = np.where(np.arange(rows) % 20 == 0, n.LEFT, n.RIGHT)
        cells = n._Cells(np.array([0, rows]), side, np.arange(rows), words, np.bitwise_count(words).sum(1, dtype=np.int64))
        cells.compare()
        return cells.best, cells.key

    tracemalloc.start()
    best, key = found(20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6)
    assert peak < 60e6
    monkeypatch.setattr(n, "WIDTH", 20_000)
    whole = found(20_000)
    assert (best == whole[0]).all() and (key == whole[1]).all()


def test_ngrams_are_digested_once_per_slice(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    from assayframe.operators import features

    texts = ["abcabcabc", None, "", "ab", "漢😀é\0abc" * 3, "xyz" * 50, "abc", "q" * 41]
    bits = lambda t: sorted({int(hashlib.md5(t[k : k + 3].encode()).hexdigest()[:8], 16) % 64 for k in range(len(t) - 2)})
    expected = [bits(t or "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = features.hashed_ngrams(df, "t", 3, 64)
    assert [r.bits for r in made.orderBy("id").collect()] == expected
    assert "zip_with" not in made._jdf.queryExecution().optimizedPlan().toString()

    own, calls, real = pa.array([t and t.encode() for t in texts], pa.binary()), [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda b, **more: calls.append(b) or real(b, **more))
    assert features._ngram_bits(3, 64)(own).to_pylist() == expected
    assert len(calls) == len(set(calls))
    monkeypatch.setattr(features, "SLICE_LETTERS", 20)  # some texts are longer
    assert features._ngram_bits(3, 64)(own).to_pylist() == expected
    assert features._ngram_bits(3, 64)(own[:0]).to_pylist() == []
    bad = features._ngram_bits(2, 64)(pa.array([b"\xff\xfea"], pa.binary())).to_pylist()[0]
    assert bad == sorted({int(real(g).hexdigest()[:8], 16) % 64 for g in (b"\xff\xfe", b"\xfea")})


def test_identities_shuffle_packs_of_different_digests(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    from assayframe.operators import identity

    sha = lambda t: hashlib.sha256(t.encode())
    rows = [sha(str(k)).digest() for k in range(500)] + [sha("7").digest()] * 300 + [b"\0" * 32, b"\xab\xc0" + b"\0" * 30, b"\xab\xc0" + b"\0" * 29 + b"\1"]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 100], pa.binary())], ["d"]) for k in range(0, len(rows), 100)]
    batches += [batches[0].slice(0, 0), pa.RecordBatch.from_arrays([pa.array(rows[:9], pa.large_binary())], ["d"]).slice(2)]
    rows += rows[2:9]
    expected = {}
    for d in sorted(set(rows)):
        expected.setdefault(int(d.hex()[:3], 16), []).append(f"{d.hex()}:{rows.count(d)}")
    for size in (1, 250, 1 << 19):
        monkeypatch.setattr(identity, "PACKED_ROWS", size)
        packs = [r for batch in identity._pack(iter(batches)) for r in batch.to_pylist()]
        if size > len(rows):
            assert len(packs) == len(expected) and sum(len(r["d"]) for r in packs) == 32 * len(set(rows))
        packs.sort(key=lambda r: r["b"])
        schema = pa.schema([("b", pa.int32()), ("d", pa.binary()), ("n", pa.list_(pa.int64()))])
        sliced = [pa.RecordBatch.from_pylist(packs, schema).slice(k, 70) for k in range(0, len(packs), 70)]
        got = [r for batch in identity._digest_buckets(iter(sliced)) for r in batch.to_pylist()]
        assert [(r["b"], r["h"]) for r in got] == [(b, sha(",".join(x)).hexdigest()) for b, x in sorted(expected.items())]
        assert sum(r["n"] for r in got) == len(rows)
    assert list(identity._pack(iter([]))) == [] and list(identity._digest_buckets(iter([]))) == []
    many = spark.range(100_000).select(F.lit("x").alias("x"), (F.col("id") % 3).cast("string").alias("y"))
    plan = identity.data_identity(many, ["x", "y"], "m")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow _pack" in plan
    told = identity.data_identity(many, ["x", "y"], "m").first()
    buckets = sorted((sha(f'{{"x":"x","y":"{k}"}}').hexdigest(), n) for k, n in ((0, 33_334), (1, 33_333), (2, 33_333)))
    assert tuple(told) == (sha("m\n" + ",".join(sha(f"{d}:{n}").hexdigest() for d, n in buckets)).hexdigest(), 100_000)
