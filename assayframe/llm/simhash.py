"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints
are merged first. A fingerprint has two 32-bit segments; of two fingerprints
that differ in at most 4 bits, one segment differs in at most 2, and then the
balls of radius 1 around both segments share a point. So every fingerprint is
listed under the 33 points of each of its segments' balls, and each list is
verified by complete distances. A list yields a spanning forest of its links,
not all pairs; connected components of the forests are those of all links.

A list longer than ``crowd`` is dealt anew, by the balls around the 16-bit
halves of the other segment, in which linked fingerprints share a point too.

Four bits of 64 are far fewer than texts of a similarity of 0.8 differ in:
those differ in 15 % of a fingerprint's bits. For such a similarity there are wide
fingerprints of 256 bits over the distinct shingles. Their segments are fixed random choices of bits, each listed under
its ball of radius 1, so that two meet where a segment differs in at most 2 bits. A segment has as many bits as
keep lists short for so many fingerprints, and there are as many segments as let all but ``LOST`` of the
pairs at 0.8 meet. Lists are first sifted by the first word
alone, then by complete distances, with a limit so loose that few pairs at 0.8 exceed it. The distance only
nominates: within the components of nominated pairs the exact similarity of the shingle sets decides each link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import fresh, meet, one_of_each, written
from assayframe.llm.components import components
from assayframe.llm.packing import slices

SEED = 42
SEGMENTS, SEGMENT_BITS, HALF_BITS = 2, 32, 16
#: Wide fingerprints: 64-bit words, bits in which nominated ones may differ (at a similarity of 0.8 the mean is 39
#: of 256), and bits in which their first words may.
WIDE_WORDS, WIDE_MOST, FIRST_MOST = 4, 64, 20
#: Share of a wide fingerprint's bits that differ at a similarity of 0.8, pairs there that may meet in no segment,
#: least bits of a segment, and fingerprints listed at once.
DIFFERS, LOST, LEAST_BITS, LIST_ROWS = 0.15, 0.0025, 20, 2_000
#: Longest lists that are compared by shifts, and as one matrix.
SHIFTED, MATRIX = 16, 512
#: A block of a component: its shingles, with so many added for each text.
BLOCK_WEIGHT, TEXT_WEIGHT = 250_000, 250


def fingerprint(text: bytes, words: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 for a text without words.

    A-Z are lower-cased, words end at ASCII white space; a bit is set if it is
    set in more than half of the shingles' hashes. Fewer words than a shingle
    has make one shingle.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    shingles = _shingles(parts, words)
    digest = xxhash.xxh64_digest
    return int(_majority(b"".join([digest(x, SEED) for x in shingles]), len(shingles)).view(">i8")[0])


def _shingles(parts: list[bytes], words: int) -> list[bytes]:
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(parts) - words + 1, 1)
    return [joined[s:e] for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]


def _majority(hashes: bytes, n: int) -> np.ndarray:
    """The bits that are set in more than half of n hashes of equal size, packed."""
    size = len(hashes) // n
    counts = np.zeros(8 * size, np.int64)
    for i in range(0, n, 255):  # 255 bits at most are added up in a byte, eight bytes at a time
        bits = np.unpackbits(np.frombuffer(hashes[size * i : size * (i + 255)], np.uint8))
        counts += bits.view(np.uint64).reshape(-1, size).sum(0).view(np.uint8)
    return np.packbits(2 * counts > n)


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[int, ...]:
    """The same over 256 bits and over the distinct shingles, as four signed 64-bit numbers."""
    parts = text.lower().split()
    if not parts:
        return (0,) * WIDE_WORDS
    shingles = set(_shingles(parts, words))
    digest = xxhash.xxh3_128_digest
    halves = [_majority(b"".join([digest(x, seed) for x in shingles]), len(shingles)) for seed in (SEED, SEED + 1)]
    return tuple(np.concatenate(halves).view(">i8").tolist())


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in order; one 0 for a text without words."""
    parts = text.lower().split()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(x) for x in set(_shingles(parts, words))] if parts else [0], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; null text counts as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                fps = [fingerprint(t or b"", words) for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _ball(value, bits: int):
    """The points within one bit of a value of so many bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(bits)])
    return F.transform(flips, lambda flip: value.bitwiseXOR(flip))


def _segment(fp, k: int, bits: int):
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1))


def candidates(fps: DataFrame, crowd: int = 100_000) -> DataFrame:
    """``key, fp``: the lists in which any two fingerprints within 4 bits meet at least once."""
    fp = F.col("fp")
    own = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(fp, k, SEGMENT_BITS).alias("value")) for k in range(SEGMENTS)])).alias("s")).select("fp", "s.*")
    keyed = lambda k, point: F.shiftleft(k.cast("long"), SEGMENT_BITS).bitwiseOR(point)
    lists = own.select("k", "fp", F.explode(_ball(F.col("value"), SEGMENT_BITS)).alias("point")).select("k", keyed(F.col("k"), F.col("point")).alias("key"), "fp")

    # A list of more than `crowd` has a segment value with at least crowd / 33 fingerprints near it; there are few such values.
    full = own.groupBy("k", "value").count().filter(F.col("count") > crowd // (SEGMENT_BITS + 1))
    points = full.select(F.explode(_ball(F.col("value"), SEGMENT_BITS)).alias("point"), "k").select(keyed(F.col("k"), F.col("point")).alias("key")).distinct()
    points = written(points, "crowded")
    if points.isEmpty():
        return lists.select("key", "fp")
    crowded = lists.join(F.broadcast(points), "key")
    other = F.when(F.col("k") == 0, _segment(fp, 1, SEGMENT_BITS)).otherwise(_segment(fp, 0, SEGMENT_BITS))

    def half(h: int):
        return F.transform(_ball(_segment(other, h, HALF_BITS), HALF_BITS), lambda p: F.xxhash64(F.col("key"), F.lit(h), p))

    halves = F.array(half(0), half(1))
    anew = crowded.select(F.explode(F.flatten(halves)).alias("key"), "fp")
    return lists.join(F.broadcast(points), "key", "left_anti").select("key", "fp").unionByName(anew)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of a signed number numpy would count those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected within a list: each step compares one member with those not yet reached."""
    rest = fps
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            a = reached.pop()
            near = differing(rest, a) <= most
            found, rest = rest[near], rest[~near]
            reached.extend(found)
            yield from ((int(a), int(b)) for b in found)


def _verify(most: int):
    def each(arrays: list[np.ndarray]) -> pa.RecordBatch:
        key, fp = arrays
        start, size = _lists(key)
        two = start[size == 2]
        near = differing(fp[two], fp[two + 1]) <= most
        pairs = [np.stack([fp[two[near]], fp[two[near] + 1]], 1)]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            pairs.append(np.array([*_forest(fp[s : s + n], most)], np.int64).reshape(-1, 2))
        out = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return _complete_lists(2, each)


def _least():
    """Aggregate: the row that stands for a group; the least doc_id, and of rows without one the least text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")).alias("least")


def _labelled(rows: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``doc_id, body, fp`` with their component, from ``fps (fp, node, least, n)`` and links between nodes.

    ``stands`` marks the rows that are the one that stands for the component.
    """
    rooted = written(fps.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")).select("fp", "least", "n", "root"), "rooted")
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"), F.sum("n").alias("component_size"))
    decided = meet(rooted.select("fp", "n", "root"), heads, "root", "component_size").drop("root")
    stands = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("body") == F.col("head.body"))
    return meet(rows, decided, "fp", "n").select("doc_id", "body", "fp", F.col("head.doc_id").alias("component_id"), "component_size", stands.alias("stands"))


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, crowd: int = 100_000) -> DataFrame:
    """``doc_id, fp, component_id, component_size`` for every row.

    Rows link whose fingerprints differ in at most ``most`` (up to 4) bits;
    component_id is the smallest doc_id reachable, null where no row has one.
    Null and empty texts have fingerprint 0. Repeated rows give repeated rows.
    """
    if most > 4:
        raise ValueError("the two segments' balls cover 4 differing bits at most")
    rows = written(fingerprints(docs, words), "fingerprints").withColumn("body", F.lit(0).cast("long"))
    fps = written(rows.groupBy("fp").agg(_least(), F.count("*").alias("n")).withColumn("node", F.col("fp")), "distinct_fps")
    lists = candidates(fps.select("fp"), crowd).repartition("key").sortWithinPartitions("key")
    return _labelled(rows, fps, lists.mapInArrow(_verify(most), "a long, b long")).drop("body", "stands")


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, body, fp`` for every row, with body a hash of the text and fp a struct of four words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                fps = np.array([wide_fingerprint(t or b"", words) for t in texts.slice(a, b - a).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in (0, 1)], *[pa.array(fps[:, k]) for k in range(WIDE_WORDS)]], names=["doc_id", "body", *names])

    names = [f"w{k}" for k in range(WIDE_WORDS)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "body", *names))).select("doc_id", "body", F.struct(*names).alias("fp"))


def _body():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _complete_lists(columns: int, each):
    """Runs ``each(arrays)`` over whole lists: batches of rows sorted by their first column, cut where it changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * columns
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on in the next batch
                yield each([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield each(held)

    return run


def _lists(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _sift(arrays: list[np.ndarray]) -> pa.RecordBatch:
    """The members of each list whose first word is near to another member's."""
    key, word = arrays
    near = np.zeros(len(key), bool)
    start, size = _lists(key)
    for d in range(1, min(SHIFTED, int(size.max(initial=0)))):
        same = (key[d:] == key[:-d]) & (differing(word[d:], word[:-d]) <= FIRST_MOST)
        near[d:] |= same
        near[:-d] |= same
    for s, n in zip(start[size > SHIFTED].tolist(), size[size > SHIFTED].tolist(), strict=True):
        some = word[s : s + n]
        if n <= MATRIX:
            near[s : s + n] = (differing(some[:, None], some[None, :]) <= FIRST_MOST).sum(1) > 1
        else:
            found = {w for pair in _forest(some, FIRST_MOST) for w in pair}
            near[s : s + n] = np.isin(some, list(found)) if found else False
    return pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(word[near])], names=["key", "w0"])


def _verify_wide(most: int):
    def each(arrays: list[np.ndarray]) -> pa.RecordBatch:
        key, node, *words = arrays
        fps = np.stack(words, axis=1)
        start, size = _lists(key)
        found = []
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            rest, todo = np.arange(s + 1, s + n), [s]
            while todo and len(rest):
                a = todo.pop()
                near = differing(fps[rest], fps[a]).sum(1, dtype=np.int64) <= most
                found.extend((int(node[a]), int(node[b])) for b in rest[near])
                todo.extend(rest[near].tolist())
                rest = rest[~near]
                if not todo and len(rest):
                    todo, rest = [int(rest[0])], rest[1:]
        out = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return each


def segments_for(rows: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many fingerprints."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 2))) - 1)
    meet = sum(math.comb(bits, k) * DIFFERS**k * (1 - DIFFERS) ** (bits - k) for k in range(3))
    return bits, math.ceil(math.log(LOST) / math.log(1 - meet))


def segment_keys(fps: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """The points of all segments' balls of radius 1 for fingerprints (rows of four words), a row each."""
    rng = np.random.default_rng(SEED)
    place = np.zeros((64 * WIDE_WORDS, segments))
    for k in range(segments):
        place[rng.choice(64 * WIDE_WORDS, bits, replace=False), k] = 2.0 ** np.arange(bits)
    each = np.unpackbits(fps.astype(">i8").view(np.uint8), axis=1).astype(np.float64)
    value = (each @ place).astype(np.int64) | np.arange(segments, dtype=np.int64) << bits
    flips = np.r_[0, 1 << np.arange(bits, dtype=np.int64)]
    return (value[:, :, None] ^ flips).reshape(len(fps), -1)


def _list(bits: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            for s in range(0, len(fps), LIST_ROWS):
                some = fps[s : s + LIST_ROWS]
                keys = segment_keys(some, bits, segments)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(some[:, 0], keys.shape[1]))], names=["key", "w0"])

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                sets = pa.array([shingle_set(t or b"", words) for t in texts.slice(a, b - a).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], sets], names=[*batch.schema.names[:-1], "shingles"])

    return run


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the other shingle sets have at least this Jaccard similarity with one."""
    size = np.array([len(o) for o in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(hit, np.r_[0, size.cumsum()[:-1]], dtype=np.int64)
    return both >= similarity * (size + len(one) - both) - 1e-9


def _verify_sets(most: int, similarity: float):
    """Runs over whole cells of ``cell, node``, words, shingles: a spanning forest of the links by exact similarity."""

    def links(node: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        rest, todo = np.arange(1, len(node)), [0]
        while todo and len(rest):
            a = todo.pop()
            same = differing(fps[rest], fps[a]).sum(1, dtype=np.int64) <= most
            if same.any():
                same[same] = alike(sets[a], [sets[b] for b in rest[same]], similarity)
            yield from ((int(node[a]), int(node[b])) for b in rest[same])
            todo.extend(rest[same].tolist())
            rest = rest[~same]
            if not todo and len(rest):
                todo, rest = [int(rest[0])], rest[1:]

    def each(numbers: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        start, size = _lists(numbers[:, 0])
        found = [pair for s, n in zip(start.tolist(), size.tolist(), strict=True) for pair in links(numbers[s : s + n, 1], numbers[s : s + n, 2:], sets[s : s + n])]
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sets = np.empty((0, 2 + WIDE_WORDS), np.int64), []
        for batch in batches:
            *columns, shingles = batch.columns
            ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            numbers = np.concatenate([numbers, np.stack([c.to_numpy() for c in columns], axis=1)])
            sets.extend(values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            if len(numbers):
                cut = int(np.searchsorted(numbers[:, 0], numbers[-1, 0]))
                yield each(numbers[:cut], sets[:cut])
                numbers, sets = numbers[cut:], sets[cut:]
        yield each(numbers, sets)

    return run


def exact_links(near: DataFrame, similarity: float, most: int, block: int = BLOCK_WEIGHT) -> DataFrame:
    """Links ``a, b`` from ``node, root, v0.., shingles``: they connect what pairs of a root with that similarity connect.

    A root of more than ``block`` is cut into blocks. Its members that are linked to the root itself need no look at each
    other; every other block meets each block in a cell. So a large group of near copies costs one pass.
    """
    weight = F.size("shingles") + TEXT_WEIGHT
    sizes = written(near.groupBy("root").agg(F.ceil(F.sum(weight) / F.lit(block)).alias("salts"), F.count("*").alias("n_near")), "root_sizes")
    tagged = meet(near, sizes, "root", "n_near")
    large = tagged.filter("salts > 1").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    heads = tagged.filter("salts > 1 and node = root").select("root", F.col("shingles").alias("head"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    both = F.size(F.array_intersect("shingles", "head"))
    star = both >= similarity * (F.size("shingles") + F.size("head") - both) - 1e-9
    met = large.join(heads, ["root", "salt"], "left").withColumn("star", F.coalesce(star, F.lit(False))).drop("head", "salt")  # a head meets one block's weight of its root's texts at a time
    told = written(tagged.filter("salts = 1").withColumn("star", F.lit(False)).unionByName(met).drop("salts", "n_near"), "starred")
    blocks = lambda own: F.ceil(F.coalesce(F.sum(F.when(own, weight)), F.lit(0)) / F.lit(block))
    counts = written(told.groupBy("root").agg(blocks(~F.col("star")).alias("others"), blocks(F.col("star")).alias("stars"), F.count("*").alias("n")), "block_counts")
    dealt = meet(told, counts, "root", "n").filter("others > 0")
    own = F.when(F.col("star"), F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("stars", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    last = F.when(F.col("star"), F.col("others")).otherwise(F.col("others") + F.col("stars")) - 1
    names = [f"v{k}" for k in range(WIDE_WORDS)]
    dealt = dealt.select("root", "node", *names, "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    cells = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", *names, "shingles")
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify_sets(most, similarity), "a long, b long")
    return found.unionByName(told.filter("star").select(F.col("root").alias("a"), F.col("node").alias("b")))


def similar(docs: DataFrame, words: int = 5, most: int = WIDE_MOST, similarity: float = 0.8, block: int = BLOCK_WEIGHT) -> DataFrame:
    """``doc_id, body, fp, component_id, component_size, stands`` for texts whose shingle sets have that Jaccard similarity or more.

    Rows are nominated whose wide fingerprints differ in at most ``most`` of 256 bits and meet in a list, and link if their
    exact similarity suffices; equal fingerprints count as equal. component_id is as in
    ``near_duplicates``. ``body`` is a hash of the text, and ``stands`` is true for the component's row of
    the smallest doc_id, or without any of the smallest body, and for rows that repeat it.
    """
    rows = written(wide_fingerprints(docs, words), "wide_fingerprints")
    fps = rows.groupBy("fp").agg(_least(), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    fps = written(fps, "distinct_wide")
    lists = fps.select(*[f"fp.w{k}" for k in range(WIDE_WORDS)]).mapInArrow(_list(*segments_for(fps.count())), "key long, w0 long").repartition("key").sortWithinPartitions("key")
    sifted = written(lists.mapInArrow(_complete_lists(2, _sift), "key long, w0 long").distinct(), "sifted")
    names = [f"v{k}" for k in range(WIDE_WORDS)]
    full = fps.select(F.col("fp.w0").alias("w0"), "node", *[F.col(f"fp.w{k}").alias(f"v{k}") for k in range(WIDE_WORDS)])
    full = sifted.join(full, "w0").select("key", "node", *names).repartition("key").sortWithinPartitions("key", "node")  # a list's least node links the rest, so lists of one group repeat links
    nominated = components(full.mapInArrow(_complete_lists(2 + WIDE_WORDS, _verify_wide(most)), "a long, b long"))

    wanted = fps.join(nominated, "node").select("node", "root", *[F.col(f"fp.w{k}").alias(f"v{k}") for k in range(WIDE_WORDS)], F.col("least.doc_id").alias("of_id"), F.col("least.body").alias("of_body"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body"), F.col("text").cast("binary").alias("text"))
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["of_id"]) & (own["body"] == wanted["of_body"])).select("node", "root", *names, "text")
    near = texts.mapInArrow(_shingle_sets(words), ", ".join(f"{c} long" for c in ("node", "root", *names)) + ", shingles array<long>")
    near = written(near.dropDuplicates(["node"]), "near_sets")
    return _labelled(rows, fps, exact_links(near, similarity, most, block))


def deduplicate(docs: DataFrame, words: int = 5, most: int = WIDE_MOST, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of ``similar`` texts, the one that stands for it; all columns stay as they are."""
    kept = similar(docs, words, most, similarity).filter("stands").select(F.col("doc_id").alias("kept_id"), F.col("body").alias("kept_body")).distinct()
    own_id, own_body = fresh(docs, "own_id"), fresh(docs, "own_body")
    own = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_body: _body()})
    joined = own.join(kept, own[own_id].eqNullSafe(kept["kept_id"]) & (own[own_body] == kept["kept_body"]), "left_semi")
    return one_of_each(joined, own_id, own_body).select(*[F.col(f"`{c}`") for c in docs.columns])
