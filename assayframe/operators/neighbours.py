"""Tanimoto nearest neighbours of bit sets, exact and approximate, class concordance and the modelability index.

Rows are packed into words once. Whatever is to be compared meets in cells of bounded size; a task goes through its cells and
returns one best neighbour per row and cell, so no pair of rows is ever a row of a table.

* Few rows: all are dealt into blocks, and every pair of blocks is a cell.
* Many rows: prefix filtering with falling thresholds. Bits are ordered by rarity; two sets with a similarity of at least t share one of
  their first |A| - ceil(t |A|) + 1 bits, and their sizes differ by a factor of 1 / t at most. So a row is listed under those bits
  and its class of sizes, a list is a cell (a long one several), and a row that finds a neighbour of at least t is settled, ties included. The rest
  goes on with the next threshold. What would be compared is counted before anything is: a threshold at which lists save too little
  is left to the blocks, for the rows not settled yet. Rows that share no bit with any other end with the least id.
* ``approximate_all``: banded MinHash, a list for each band's key, again counted before it is dealt; long lists are split by a second
  band, and rows without a good neighbour are compared exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.streaming.shared import written

BLOCK_ROWS, LEAST_BLOCK, STEP, WIDTH = 20_000, 250, 256, 2_048
#: Rows from which on thresholds are tried, the thresholds in tenths (0: any shared bit), and the share of all pairs that lists may compare.
PRUNED_ROWS, TENTHS, WORTH = 20_000, (8, 6, 4, 2, 0), 0.25
#: Pairs of rows compared at once, and rows of cells gone through together: bounds on memory only.
PAIRS, FLUSH_ROWS = 400_000, 50_000
#: What a row does in its cell: asks those that are HELD; all MEMBERS ask each other; those on the LEFT and on the RIGHT ask each other.
ASKS, HELD, MEMBER, LEFT, RIGHT = range(5)
BEST = "id string, nb_id string, nb_outcome string, key double"
REPORT_COLUMNS = ("id", "outcome", "neighbour_id", "neighbour_outcome", "similarity", "concordant")


def _packed(n_words: int):
    """id, outcome, bits in; with the bits' words and number out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(2)
            sizes = np.diff(bits.offsets.to_numpy()) if bits.null_count == 0 else np.array([len(x) if x else 0 for x in bits.to_pylist()], np.int64)
            on = bits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            words = np.zeros((len(batch), n_words), np.uint64)
            np.bitwise_or.at(words, (np.repeat(np.arange(len(batch)), sizes), on >> 6), np.uint64(1) << (on & 63).astype(np.uint64))
            told = pa.array([w.tobytes() for w in words], pa.binary())
            n = pa.array(np.bitwise_count(words).sum(1, dtype=np.int64).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), told, n], names=["id", "outcome", "words", "n_on"])

    return run


def pack(fingerprints: DataFrame, n_bits: int) -> DataFrame:
    """``id, outcome, words, n_on`` of on-bit positions below ``n_bits``; repeated positions count once, null is no bit."""
    own = fingerprints.select(F.col("id").cast("string").alias("id"), F.col("outcome").cast("string").alias("outcome"), F.col("bits").cast("array<int>").alias("bits"))
    return own.mapInArrow(_packed(math.ceil(n_bits / 64)), "id string, outcome string, words binary, n_on int")


@dataclass
class _Cells:
    """Whole cells' rows in the order of (cell, id)."""

    starts: np.ndarray
    side: np.ndarray
    code: np.ndarray
    words: np.ndarray
    n_on: np.ndarray

    def __post_init__(self):
        self.best, self.key = np.full(len(self.side), -1), np.full(len(self.side), -1.0)

    @classmethod
    def of(cls, table: pa.Table) -> _Cells:
        cell = table["cell"].to_numpy()
        words = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        told = table["id"].combine_chunks().dictionary_encode()
        rank = np.empty(len(told.dictionary), np.int64)
        rank[pc.sort_indices(told.dictionary).to_numpy()] = np.arange(len(rank))
        code = rank[told.indices.to_numpy()]  # in the order of ids
        return cls(np.append(np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)), len(cell)), table["side"].to_numpy(), code, words, np.bitwise_count(words).sum(1, dtype=np.int64))

    def compare(self) -> None:
        small = []
        for s, e in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if e - s <= 2 * STEP:
                small.append((s, e))
            else:
                self._matrix(s, e)
        self._lists(small)

    def _keys(self, both: np.ndarray, joint: np.ndarray, same: np.ndarray) -> np.ndarray:
        key = np.divide(both, joint, out=np.full(both.shape, 2.0), where=joint > 0)  # nothing over nothing comes first
        key[same] = -1.0
        return key

    def _offer(self, rows: np.ndarray, best: np.ndarray, key: np.ndarray) -> None:
        better = key > self.key[rows]
        self.best[rows[better]], self.key[rows[better]] = best[better], key[better]

    def _matrix(self, s: int, e: int) -> None:
        """A long cell: tiles of one side and the other, in the order of ids; of equal ones the first, that is the least id."""
        at = np.arange(s, e)
        side = self.side[s:e]
        for asks, held, mutual in ((ASKS, HELD, False), (MEMBER, MEMBER, False), (LEFT, RIGHT, True)):
            a, others = at[side == asks], at[side == held]
            for i, j in itertools.product(range(0, len(a), STEP), range(0, len(others), WIDTH)):
                own, b = a[i : i + STEP], others[j : j + WIDTH]
                both = np.zeros((len(own), len(b)), np.int64)
                for w in range(self.words.shape[1]):
                    both += np.bitwise_count(self.words[own, w, None] & self.words[None, b, w])
                key = self._keys(both, self.n_on[own, None] + self.n_on[None, b] - both, self.code[own, None] == self.code[None, b])
                most = key.argmax(1)
                self._offer(own, b[most], key[np.arange(len(own)), most])  # of equal ones an earlier tile's stays
                if mutual:
                    most = key.argmax(0)
                    self._offer(b, own[most], key[most, np.arange(len(b))])

    def _lists(self, cells: list[tuple[int, int]]) -> None:
        """Short cells, many at once: each asking row with all rows that it asks."""
        asking, low = [], []
        for s, e in cells:
            side = self.side[s:e]
            for asks, held in ((ASKS, HELD), (MEMBER, MEMBER), (LEFT, RIGHT), (RIGHT, LEFT)):
                if (side == asks).any() and (side == held).any():
                    rows, others = s + np.flatnonzero(side == asks), s + np.flatnonzero(side == held)
                    asking.append(np.repeat(rows, len(others)))
                    low.append(np.tile(others, len(rows)))
            if sum(map(len, asking)) > PAIRS:
                self._pairs(np.concatenate(asking), np.concatenate(low))
                asking, low = [], []
        if asking:
            self._pairs(np.concatenate(asking), np.concatenate(low))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        both = np.bitwise_count(self.words[a] & self.words[b]).sum(1, dtype=np.int64)
        key = self._keys(both, self.n_on[a] + self.n_on[b] - both, self.code[a] == self.code[b])
        first = np.flatnonzero(np.diff(a, prepend=-1))
        most = np.maximum.reduceat(key, first)
        hit = np.flatnonzero(key == np.repeat(most, np.diff(np.append(first, len(a)))))
        hit = hit[np.searchsorted(hit, first)]
        self._offer(a[first], b[hit], most)


def _through_cells(least: float):
    """The best neighbour of each asking row in each cell, where it reaches ``least``; rows come in the order of cells and ids."""

    def best_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        cells = _Cells.of(table)
        cells.compare()
        good = np.flatnonzero((cells.best >= 0) & (cells.key >= max(least, 0.0)))
        good = good[np.lexsort((cells.code[cells.best[good]], -cells.key[good], cells.code[good]))]
        good = good[np.flatnonzero(np.diff(cells.code[good], prepend=-1))]  # one for each row of all these cells
        ids, outcomes = table["id"].combine_chunks(), table["outcome"].combine_chunks()
        own, near = pa.array(good), pa.array(cells.best[good])
        yield pa.RecordBatch.from_arrays([ids.take(own), ids.take(near), outcomes.take(near), pa.array(cells.key[good])], names=["id", "nb_id", "nb_outcome", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < FLUSH_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            cell = table["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            yield from best_of(table.slice(0, whole))
            waiting = table.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield from best_of(pa.Table.from_batches(waiting))

    return run


def _best(cells: DataFrame, least: float = 0.0, n_cells: int | None = None) -> DataFrame:
    """``id, nb_id, nb_outcome, key`` over all cells; of equal keys the least id. A key of 2 stands for NaN."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if n_cells is None else max(1, min(parts, n_cells))  # a fixed number: cells are small in bytes and long in work
    own = cells.select("cell", "side", "id", "outcome", "words").repartition(parts, "cell").sortWithinPartitions("cell", "id")
    found = own.mapInArrow(_through_cells(least), BEST)
    return found.groupBy("id").agg(F.min(F.struct((-F.col("key")).alias("key"), "nb_id", "nb_outcome")).alias("b")).select("id", "b.nb_id", "b.nb_outcome", (-F.col("b.key")).alias("key"))


def _blocks(own: DataFrame, asked: DataFrame | None, n: int, block_rows: int) -> DataFrame:
    """Every pair of blocks as a cell; where all rows ask, each pair of blocks once, for both sides."""
    blocks = max(1, math.ceil(n / block_rows), min(8, n // LEAST_BLOCK))
    block, other = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = own.select("id", "outcome", "words", block.alias("block"), other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    if asked is None:
        side = F.when(F.col("block") == F.col("other"), MEMBER).when(F.col("block") < F.col("other"), LEFT).otherwise(RIGHT)
        return _best(own.select((low * blocks + high).alias("cell"), side.alias("side"), "id", "outcome", "words"), n_cells=blocks * (blocks + 1) // 2)
    held = own.select((F.col("other") * blocks + F.col("block")).alias("cell"), F.lit(HELD).alias("side"), "id", "outcome", "words")
    asking = asked.select("id", "outcome", "words", block.alias("block"), other.alias("other")).select((F.col("block") * blocks + F.col("other")).alias("cell"), F.lit(ASKS).alias("side"), "id", "outcome", "words")
    return _best(held.unionByName(asking), n_cells=blocks * blocks)


def _size_class(tenths: int, n_bits: int) -> Column:
    """Sizes in classes such that a factor of 1 / t leads to the next class at most."""
    bounds = [1]
    while tenths and bounds[-1] <= n_bits:
        bounds.append(bounds[-1] * 10 // tenths + 1)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("n_on")))


def _listed(rows: DataFrame, tenths: int, n_bits: int, reach: int) -> DataFrame:
    """A row for each list that a row belongs to: its rarest bits, and its class of sizes with ``reach`` classes on both sides."""
    first = F.col("n_on") - F.ceil(F.col("n_on") * tenths / 10).cast("int") + (1 if tenths else 0)
    some = rows.withColumn("prefix", F.slice("ranks", 1, F.greatest(first, F.lit(0))))
    own = _size_class(tenths, n_bits)
    classes = F.sequence(own - reach, own + reach) if tenths else F.array(F.lit(0))
    return some.select("id", "outcome", "words", F.explode("prefix").alias("bit"), classes.alias("classes")).select("id", "outcome", "words", "bit", F.explode("classes").alias("size_class"))


def _pruned(own: DataFrame, asked: DataFrame, tenths: int, n_bits: int, n: int, n_asked: int, block_rows: int, report: list | None) -> DataFrame | None:
    """Best neighbours of a similarity of at least tenths / 10 by lists, or None where lists would compare too much."""
    listed = lambda rows, reach: _listed(rows, tenths, n_bits, reach)
    by = ["bit", "size_class"]
    sizes = listed(asked, 1).groupBy(*by).agg(F.count("*").alias("n_asked")).join(listed(own, 0).groupBy(*by).agg(F.count("*").alias("n_held")), by)
    sizes = written(sizes, "list-sizes")  # a row for each bit and class at most
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n_asked") * F.col("n_held")), F.lit(0))).first()[0]
    if pairs > WORTH * n * n_asked:
        return None
    if report is not None:
        report.append((tenths, n_asked, int(pairs)))
    parts = sizes.select(*by, F.ceil(F.col("n_asked") / block_rows).alias("asked_parts"), F.ceil(F.col("n_held") / block_rows).alias("held_parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    asking = listed(asked, 1).join(F.broadcast(parts), by).select("*", part("asked_parts").alias("i"), each("held_parts").alias("j"), F.lit(ASKS).alias("side"))
    held = listed(own, 0).join(F.broadcast(parts), by).select("*", each("asked_parts").alias("i"), part("held_parts").alias("j"), F.lit(HELD).alias("side"))
    cells = asking.unionByName(held).withColumn("cell", F.xxhash64("bit", "size_class", "i", "j"))
    return _best(cells, tenths / 10 or 1e-12)


def _ranked(packed: DataFrame, fingerprints: DataFrame, n_bits: int) -> DataFrame:
    """Packed rows with their bits as ranks by rarity, rarest first; the order of at most ``n_bits`` bits passes through the driver."""
    bits = fingerprints.select(F.col("id").cast("string").alias("id"), F.array_distinct(F.col("bits").cast("array<int>")).alias("bits"))
    told = bits.select(F.explode("bits").alias("bit")).groupBy("bit").count().orderBy("count", "bit").select("bit").collect()
    rank = np.zeros(n_bits, np.int64)
    rank[[r.bit for r in told]] = np.arange(len(told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
            row, bit = np.nonzero(np.unpackbits(words, axis=1, bitorder="little"))
            order = np.lexsort((rank[bit], row))
            ends = np.searchsorted(row, np.arange(len(batch) + 1))
            ranks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rank[bit][order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ranks], names=[*batch.schema.names, "ranks"])

    return packed.mapInArrow(run, "id string, outcome string, words binary, n_on int, ranks array<int>")


def _copies(own: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of each different set, the least id's; and the asking rows that have a copy, or none of them any bit, with the least id among these.

    Spark keeps each task's two least ids before the shuffle, so that a set that very many rows have is no hot spot.
    """
    by = Window.partitionBy("words").orderBy("id")
    two = own.select("id", "outcome", "words", "n_on", "ranks").withColumn("place", F.row_number().over(by)).filter("place <= 2")
    two = written(two, "copies")
    second = two.filter("place = 2").select("words", F.struct("id", "outcome").alias("second"))
    pairs = two.filter("place = 1").select("words", F.struct("id", "outcome").alias("first")).join(second, "words", "left")
    near = F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    same = asked.select("id", "words", "n_on").join(pairs, "words").select("id", near.alias("near"), F.when(F.col("n_on") == 0, 2.0).otherwise(1.0).alias("key"))
    return two.filter("place = 1").drop("place"), same.filter("near is not null").select("id", F.col("near.id").alias("nb_id"), F.col("near.outcome").alias("nb_outcome"), "key")


def _farthest(own: DataFrame, asked: DataFrame) -> DataFrame:
    """For rows without a bit in common with any other: the least id that isn't their own."""
    two = own.select("id", "outcome").orderBy("id").limit(2).collect()
    told = [(*(a or (None, None)), *(b or (None, None))) for a, b in [(two + [None, None])[:2]]]
    names = own.sparkSession.createDataFrame(told, "a string, a_outcome string, b string, b_outcome string")
    first = F.col("a") != F.col("id")
    out = asked.select("id").crossJoin(F.broadcast(names))  # one row
    return out.select("id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("nb_id"), F.when(first, F.col("a_outcome")).otherwise(F.col("b_outcome")).alias("nb_outcome"), F.lit(0.0).alias("key")).filter("nb_id is not null")


def nearest(fingerprints: DataFrame, n_bits: int, block_rows: int = BLOCK_ROWS, queries: DataFrame | None = None, pruned_rows: int = PRUNED_ROWS, report: list | None = None) -> DataFrame:
    """``id, outcome, neighbour_id, neighbour_outcome, similarity, concordant`` for ``id, outcome, bits`` (on-bit positions).

    Ids are unique texts. Of equally near rows the least id is the neighbour. Two
    rows without any bit are NaN alike, and NaN counts as nearest. A single row has no neighbour.
    ``queries`` are the rows to find neighbours for where that isn't all of them. From ``pruned_rows`` rows on thresholds are tried;
    ``report`` gets (threshold in tenths, rows that ask, pairs compared) of each, and (None, rows, pairs) of the blocks.
    """
    own = written(pack(fingerprints, n_bits), "packed")
    asked = own if queries is None else written(pack(queries, n_bits), "asked")
    n = own.count()
    if n < pruned_rows:
        best = _blocks(own, None if queries is None else asked, n, block_rows)
    else:
        best = _by_thresholds(_ranked(own, fingerprints, n_bits), asked if queries is None else _ranked(asked, fingerprints, n_bits), queries is None, n_bits, n, block_rows, report)
    similarity = F.when(F.col("key") == 2.0, F.lit(float("nan"))).otherwise(F.col("key"))
    out = asked.select("id", "outcome").join(best, "id")
    return out.select("id", "outcome", F.col("nb_id").alias("neighbour_id"), F.col("nb_outcome").alias("neighbour_outcome"), similarity.alias("similarity"), (F.col("outcome") == F.col("nb_outcome")).alias("concordant"))


def _by_thresholds(own: DataFrame, asked: DataFrame, all_ask: bool, n_bits: int, n: int, block_rows: int, report: list | None) -> DataFrame:
    every = written(own, "ranked")
    left = every if all_ask else written(asked, "ranked-asked")
    own, same = _copies(every, left)
    done = [written(same, "settled")]
    left = left.join(done[0].select("id"), "id", "left_anti")
    whole = True
    for tenths in TENTHS:
        left = written(left, "left")
        n_left = left.count()
        if not n_left:
            return _union(done)
        found = _pruned(own, left, tenths, n_bits, n, n_left, block_rows, report)
        if found is None:
            if report is not None:
                report.append((None, n_left, n_left * n))
            done.append(_blocks(own, left, n, block_rows))
            whole = False
            break
        found = written(found, "settled")
        done.append(found)
        left = left.join(found.select("id"), "id", "left_anti")
    if whole:  # no bit in common with any other row: all are equally far
        done.append(_farthest(every, left))
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_concordance(neighbours: DataFrame) -> DataFrame:
    """``outcome, rows, concordance`` per class."""
    return neighbours.groupBy("outcome").agg(F.count("*").alias("rows"), F.avg(F.col("concordant").cast("double")).alias("concordance"))


def modelability_index(neighbours: DataFrame) -> DataFrame:
    """One row: the mean of the classes' concordances, and the rows. Both classes must occur."""
    classes = class_concordance(neighbours).limit(3).collect()
    if {r.outcome for r in classes} != {"Active", "Inactive"}:
        raise ValueError("both outcomes, Active and Inactive, must occur")
    index = sum(r.concordance for r in classes) / 2
    return neighbours.sparkSession.createDataFrame([(index, sum(r.rows for r in classes))], "modelability_index double, rows long")


def write_report(neighbours: DataFrame, path: str) -> None:
    neighbours.select(*REPORT_COLUMNS).orderBy("id").write.mode("errorifexists").option("header", True).csv(path)


#: Bands of the approximate tier, hashes in a band, and the longest list that isn't split by a second band.
BANDS, BAND_HASHES, LONG_LIST = 24, 3, 2_000


def _banded(n_bits: int, bands: int, hashes: int, seed: int):
    """id, outcome, words in; with one key for each band out. A key mixes the least hashed bits of its band's permutations."""
    order = np.random.default_rng(seed).permuted(np.tile(np.arange(n_bits, dtype=np.uint64), (bands * hashes, 1)), axis=1)
    salt = np.random.default_rng(seed + 1).integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
            row, bit = np.nonzero(np.unpackbits(words, axis=1, bitorder="little"))
            first = np.searchsorted(row, np.arange(len(batch)))
            keys = np.zeros((len(batch), bands), np.int64)
            for b in range(bands):
                least = np.stack([np.minimum.reduceat(order[b * hashes + k][bit], first) for k in range(hashes)])
                keys[:, b] = ((least + np.uint64(1)) * salt[:, None]).sum(0, dtype=np.uint64).view(np.int64)
            told = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], told], names=["id", "outcome", "words", "keys"])

    return run


def approximate(fingerprints: DataFrame, n_bits: int, least_similarity: float = 0.3, bands: int = BANDS, hashes: int = BAND_HASHES, long_list: int = LONG_LIST, seed: int = 7) -> DataFrame | None:
    """``id, neighbour_id, similarity`` by banded MinHash: rows without a found neighbour of that similarity are missing.

    Lists are counted first. Where they would compare as many pairs as there are, there is nothing to gain: the result is None.
    A list of more than ``long_list`` rows is split by the next band's key, which may part rows that only this band would have brought together.
    """
    own = pack(fingerprints, n_bits).filter("n_on > 0").select("id", "outcome", "words")
    own = written(own.mapInArrow(_banded(n_bits, bands, hashes, seed), "id string, outcome string, words binary, keys array<long>"), "banded")
    n, key = own.count(), lambda k: F.xxhash64(k, F.get("keys", k))
    second = F.xxhash64(key(F.col("band")), F.get("keys", (F.col("band") + 1) % bands))
    lists = own.select("id", "outcome", "words", "keys", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    light = own.select("keys", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select(key(F.col("band")).alias("one"), second.alias("two"))
    counted = light.groupBy("one", "two").count()
    sizes = counted.groupBy("one").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("split"))
    pairs = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > long_list, F.col("split")).otherwise(F.col("n") * F.col("n"))), F.lit(0))).first()[0]
    if pairs > n * n:
        return None
    long_ones = written(sizes.filter(F.col("n") > long_list).select("one"), "long-lists")  # rows x bands / long_list of them at most
    keyed = lists.withColumns({"one": key(F.col("band")), "two": second})
    cells = keyed.join(long_ones.withColumn("long", F.lit(True)), "one", "left").withColumn("cell", F.when(F.col("long"), F.col("two")).otherwise(F.col("one")))
    found = _best(cells.withColumn("side", F.lit(MEMBER)), least_similarity)
    return found.select("id", F.col("nb_id").alias("neighbour_id"), F.col("key").alias("similarity"))


def approximate_all(fingerprints: DataFrame, n_bits: int, least_similarity: float = 0.5, bands: int = BANDS, hashes: int = BAND_HASHES, long_list: int = LONG_LIST, seed: int = 7) -> DataFrame:
    """``approximate`` for every row: those that it finds no neighbour for are compared exactly with all rows."""
    found = approximate(fingerprints, n_bits, least_similarity, bands, hashes, long_list, seed)
    if found is None:
        return nearest(fingerprints, n_bits).select("id", "neighbour_id", "similarity")
    found = written(found, "near")
    rest = fingerprints.join(found.select(F.col("id").alias("found_id")), F.col("id").cast("string") == F.col("found_id"), "left_anti")
    exact = nearest(fingerprints, n_bits, queries=rest)
    return found.unionByName(exact.select("id", "neighbour_id", "similarity"))
