"""Nearest neighbours: thresholds and lists give what comparing all with all gives."""

import numpy as np
import pytest

from assayframe.operators import neighbours
from assayframe.plans.queries import _fingerprints

BITS = 512


def _sparse(rng, n, families=60, spread=3):
    """Sets of 8 to 30 bits: families of similar ones, copies, loners and empty ones."""
    base = [rng.choice(BITS, rng.integers(8, 30), replace=False) for _ in range(families)]
    rows = []
    for i in range(n):
        kind = i % 10
        if kind < 7:
            bits = {*base[rng.integers(families)].tolist()}
            for _ in range(rng.integers(0, spread + 1)):
                bits.discard(int(rng.integers(BITS)))
                bits.add(int(rng.integers(BITS)))
        elif kind == 9 and i % 50 == 9:
            bits = set()
        else:
            bits = {int(b) for b in rng.choice(BITS, rng.integers(1, 25))}
        rows.append((f"r{i:06d}", "Active" if rng.random() < 0.5 else "Inactive", sorted(bits)))
    rows += [(f"c{i}", "Active", rows[3][2]) for i in range(n // 3)]  # a third of all rows are equal
    return rows


def _brute(rows):
    rows = sorted(rows)
    x = np.zeros((len(rows), BITS), np.int64)
    for k, (_, _, bits) in enumerate(rows):
        x[k, list(bits or [])] = 1
    out, n_on = {}, x.sum(1)
    for s in range(0, len(rows), 500):
        both = x[s : s + 500] @ x.T
        joint = n_on[s : s + 500, None] + n_on[None] - both
        key = np.where(joint > 0, both / np.maximum(joint, 1), 2.0)
        key[np.arange(len(both)), s + np.arange(len(both))] = -1
        for k, j in enumerate(key.argmax(1)):
            out[rows[s + k][0]] = (rows[j][0], rows[j][1], float(key[k, j]))
    return out


def _got(df):
    return {r.id: (r.neighbour_id, r.neighbour_outcome, 2.0 if r.similarity != r.similarity else r.similarity) for r in df.collect()}


@pytest.mark.parametrize("worth, block", [(0.25, 20_000), (10**9, 90), (0.0, 90)])
def test_thresholds_equal_brute_force(spark, monkeypatch, worth, block):
    monkeypatch.setattr(neighbours, "WORTH", worth)  # read where plans are made
    rows = _sparse(np.random.default_rng(1), 700)
    df = spark.createDataFrame([*rows, ("null", "Active", None)], "id string, outcome string, bits array<int>").repartition(5)
    want = _brute([*rows, ("null", "Active", [])])
    report = []
    assert _got(neighbours.nearest(df, BITS, block, pruned_rows=0, report=report)) == want
    assert any(r[0] is None for r in report) == (worth < 1e9) and (worth or len(report) == 1)
    if worth:
        return
    assert _got(neighbours.nearest(df, BITS, 300)) == want
    asked = df.filter("id like '%7'")
    assert _got(neighbours.nearest(df, BITS, 90, queries=asked, pruned_rows=0)) == {k: v for k, v in want.items() if k.endswith("7")}


def test_rows_with_nothing_in_common_and_tiny_tables(spark):
    make = lambda *bits: spark.createDataFrame([(chr(97 + i), "Active", list(b)) for i, b in enumerate(bits)], "id string, outcome string, bits array<int>")
    for pruned in (0, 10**9):
        got = _got(neighbours.nearest(make([1], [2], [3], []), 4, pruned_rows=pruned))
        assert got == {"a": ("b", "Active", 0.0), "b": ("a", "Active", 0.0), "c": ("a", "Active", 0.0), "d": ("a", "Active", 0.0)}
        assert _got(neighbours.nearest(make([], [], [1]), 4, pruned_rows=pruned)) == {"a": ("b", "Active", 2.0), "b": ("a", "Active", 2.0), "c": ("a", "Active", 0.0)}
        assert _got(neighbours.nearest(make([1]), 4, pruned_rows=pruned)) == {} == _got(neighbours.nearest(make(), 4, pruned_rows=pruned))


def test_fifty_thousand_sparse_sets_equal_the_blocks(spark):
    """Lists compare a small part of all pairs, and the result is that of the blocks."""
    compared = {}
    for n in (20_000, 50_000):
        rng = np.random.default_rng(n)
        size, bits = rng.integers(6, 14, n), 2048
        told = np.minimum((rng.pareto(0.6, (n, 14)) * 20).astype(np.int64), 10**9) * 7919 % bits
        family = rng.integers(0, n // 8, n)
        core = rng.integers(0, bits, (n // 8, 10))
        rows = [(f"{i:06d}", "Active", sorted({*core[family[i]].tolist(), *told[i, : size[i] // 5].tolist()} if i % 4 else set(rng.integers(0, bits, size[i]).tolist()))) for i in range(n)]
        df = spark.createDataFrame(rows, "id string, outcome string, bits array<int>").repartition(8)
        report = []
        pruned = neighbours.nearest(df, bits, pruned_rows=0, report=report)
        compared[n] = sum(r[2] for r in report)
        print(n, report)
        if n == 50_000:
            whole = neighbours.nearest(df, bits, pruned_rows=10**9)
            assert pruned.exceptAll(whole).isEmpty() and whole.count() == pruned.count() == n
    assert all(compared[n] < 0.06 * n**2 for n in compared)


def test_approximate_neighbours_of_twenty_thousand_rows(spark):
    rng = np.random.default_rng(5)
    core, n, bits = rng.integers(0, 1024, (4000, 20)), 20_000, 1024
    rows = []
    for i in range(n):
        own = {*core[i % 4000].tolist()} - {int(core[i % 4000, k]) for k in range(rng.integers(0, 3))} | {*rng.integers(0, bits, rng.integers(0, 4)).tolist()}
        rows.append((f"{i:05d}", "Active", sorted(own)))
    rows += [(f"e{i}", "Active", []) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, outcome string, bits array<int>").repartition(8)
    found = {r.id: r.similarity for r in neighbours.approximate_all(df, bits).collect()}
    exact = {r.id: r.similarity for r in neighbours.nearest(df, bits).collect()}
    same = sum(abs(found[k] - exact[k]) < 1e-12 or (found[k] != found[k] and exact[k] != exact[k]) for k in exact)
    hashed = neighbours.approximate(df, bits, 0.5).count()
    print("recall", same / len(exact), "found by hashes", hashed)
    assert found.keys() == exact.keys() and same >= 0.95 * len(exact) and hashed > 0.95 * n


def test_long_lists_are_split(spark):
    rows = _sparse(np.random.default_rng(3), 900)
    df = spark.createDataFrame(rows, "id string, outcome string, bits array<int>")
    want = _brute(rows)
    whole = neighbours.approximate(df, BITS, 0.5, long_list=10)
    got = {r.id: r.similarity for r in (whole.collect() if whole is not None else [])}
    assert all(got[k] <= want[k][2] + 1e-12 for k in got)
    every = {r.id: r.similarity for r in neighbours.approximate_all(df, BITS, 0.5, long_list=10).collect()}
    same = sum(abs(every[k] - want[k][2]) < 1e-12 or (every[k] != every[k] and want[k][2] == 2.0) for k in want)
    assert every.keys() == want.keys() and same >= 0.9 * len(want)


def test_registered_fingerprints_by_thresholds(spark):
    df = _fingerprints(spark, "/root/testdata/sf0.01")
    a, b = (neighbours.nearest(df, 64, pruned_rows=k).collect() for k in (0, 10**9))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 400
