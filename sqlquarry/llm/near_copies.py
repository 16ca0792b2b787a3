"""Near copies by Jaccard similarity of word shingles: banded MinHash keys for candidates, exact sets for the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, sized, slices, spread_join, tidy, written
from .graph import components
from .simhash import _FOLD

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Of the BANDS * ROWS marks of two texts, so many are equal at least, or the pair is not verified: at 0.8, 100 are equal on
#: average, and fewer than 75 with a probability of 2e-8.
MARKS_EQUAL = 75
#: Rows of one key that one task compares; a larger bucket is compared block by block in several tasks.
BLOCK = 512
#: Bands whose buckets are compared first, as links found there leave less to compare in the others.
FIRST_BANDS = 4
#: Bytes of a group's table of sets as bits; a larger one is compared set by set.
BITS_BYTES = 64 << 20
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 1 << 63, (BANDS, ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS, ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; a text of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    parts = [words] if n == 1 else zip(*[words[i : n + i] for i in range(shingle)], strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(s) for s in map(b" ".join, parts)), np.uint64, n))


def band_keys(h: np.ndarray) -> tuple[list[int], bytes]:
    """A key for each band (of its number and the smallest values of its mixed hashes), and a byte of each of those values."""
    from xxhash import xxh64_intdigest

    if not len(h):
        return [], b""
    low = np.stack([np.min((h ^ x) * m, axis=1) for x, m in zip(_XOR, _ODD, strict=True)])
    keys = [xxh64_intdigest(v.astype("<u8").tobytes(), k) - (1 << 63) for k, v in enumerate(low)]
    return keys, (low >> np.uint64(24)).astype(np.uint8).tobytes()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows behind equal (key, i, j) in sorted batches."""
    now, rows = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            for key, i, j, *row in zip(*(x.to_pylist() for x in batch.slice(lo, BLOCK).columns), strict=True):
                if (key, i, j) != now:
                    if rows:
                        yield now, rows
                    now, rows = (key, i, j), []
                rows.append(tuple(row))
    if rows:
        yield now, rows


def _promising(at: tuple, band: np.ndarray, side: np.ndarray, c: np.ndarray, sig: np.ndarray, k: int) -> np.ndarray:
    """The rows behind k (of two blocks, in the other one) with another c, enough equal marks, and no lower band in common,
    which would have the pair too."""
    other = np.nonzero((c != c[k]) & ((side > side[k]) if at[1] != at[2] else (np.arange(len(c)) > k)))[0]
    equal = sig[other] == sig[k]
    near = equal.sum(axis=1) >= MARKS_EQUAL
    other, equal = other[near], equal[near]
    lower = equal.reshape(len(other), BANDS, ROWS).all(axis=2)[:, : int(band[k])].any(axis=1)
    return other[~lower]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over sorted rows (key, i, j, side, band, row, c, sig): those with a pair that may be similar."""
    for at, rows in _groups(batches):
        side, band, row, c = np.array([r[:4] for r in rows], np.int64).T
        sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        some = np.zeros(len(rows), bool)
        for k in range(len(rows)):
            near = _promising(at, band, side, c, sig, k)
            some[near] = True
            some[k] |= len(near) > 0
        if some.any():
            n = int(some.sum())
            fixed = [pa.array(np.full(n, x), t) for x, t in zip(at, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(side[some], pa.int32()), pa.array(band[some], pa.int32()), pa.array(row[some], pa.int64()), pa.array(c[some], pa.int64())], names=["key", "i", "j", "side", "band", "row", "c"])


def _forest(similarity: float):
    """For mapInArrow over sorted rows (key, i, j, side, band, row, c, sig, h): edges of similar pairs that join what all
    similar pairs of a group join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _groups(batches):
            side, band, row, c = np.array([r[:4] for r in rows], np.int64).T
            sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
            sets = [np.frombuffer(r[5], "<u8") for r in rows]
            size = np.array([len(h) for h in sets])
            shared = _shared(sets)
            label = c.copy()
            left, right = [], []
            for k in range(len(rows)):
                near = _promising(at, band, side, label, sig, k)
                near = near[np.minimum(size[near], size[k]) >= similarity * np.maximum(size[near], size[k])]
                if len(near):
                    both = shared(near, k)
                    near = near[both >= similarity * (size[near] + size[k] - both)]
                for o in near.tolist():
                    if label[o] != label[k]:
                        label[label == label[o]] = label[k]
                        left.append(min(row[k], row[o]))
                        right.append(max(row[k], row[o]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _shared(sets: list[np.ndarray]):
    """A function of set numbers and a set number: how many values each of the former shares with the latter."""
    sizes = [len(h) for h in sets]
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # values of one set only are shared by none
    width = int(column[-1]) // 8 + 1 if len(values) else 1
    if width * len(sets) > BITS_BYTES:
        return lambda some, k: np.array([len(np.intersect1d(sets[o], sets[k], assume_unique=True)) for o in some.tolist()], np.int64)
    bits = np.zeros((len(sets), width + -width % 8), np.uint8)
    kept = count[index] > 1
    where = column[index][kept]
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), sizes)[kept], where >> 3), (1 << (where & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    return lambda some, k: np.bitwise_count(words[some] & words[k]).sum(axis=1, dtype=np.int64)


def similar_groups(docs: DataFrame, row_col: str, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, candidates: DataFrame | None = None) -> DataFrame:
    """(row_col, component) for every row of docs, of which row_col is a unique long: the smallest such number reachable over
    pairs whose shingle sets have at least the Jaccard similarity.

    Rows of equal sets (null and wordless texts among them) are one node. Pairs (a, b) of candidates, and the first row of each
    key with the others of the key, are verified by a join. The rest of a key's pairs that are not yet in one component are
    compared on their exact sets inside the tasks that get the key, so that only a forest of links leaves them. An empty table
    gives no rows; other columns are not carried.
    """
    from xxhash import xxh3_128_digest

    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("t"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                same, keys, sigs = [], [], []
                for t in part.column("t").to_pylist():
                    h = shingles(t, shingle)
                    same.append(xxh3_128_digest(h.astype("<u8").tobytes()))
                    k, s = band_keys(h)
                    keys.append(k)
                    sigs.append(s)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["row", "same", "keys", "sig"])

    marks = written(texts.mapInArrow(tidy(signed), "row long, same binary, keys array<long>, sig binary"))
    total = marks.count()
    first = written(marks.groupBy("same").agg(F.min(F.struct("row", "keys", "sig")).alias("f"), F.count("*").alias("n")).select("same", "f.row", "f.keys", "f.sig", "n"))
    twins = spread_join(marks.select("same", "row"), first.where("n > 1").select("same", F.col("row").alias("b"), "n"), "same", "n", total)
    twins = twins.where("row <> b").select(F.col("row").alias("a"), "b")
    keyed = first.select("row", F.posexplode("keys").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.min("row").alias("low"), F.count("*").alias("n")).where("n > 1"))
    keyed = written(spread_join(keyed, shared, "key", "n", total))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                h = [shingles(t, shingle).astype("<u8").tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(h, pa.binary())], names=["row", "h"])

    def sets_of(rows: DataFrame) -> DataFrame:
        return written(texts.join(sized(written(rows.distinct())), "row", "left_semi").mapInArrow(tidy(sets), "row long, h binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct())

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                    ok.append(both >= similarity * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        of = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("row")))
        full = salted_join(pairs, of.select(F.col("row").alias("b"), F.col("h").alias("y")), "b", pairs)
        full = salted_join(full, of.select(F.col("row").alias("a"), F.col("h").alias("x")), "a", pairs)
        return written(full.select("a", "b", "x", "y").mapInArrow(tidy(close), "a long, b long"))

    stars = keyed.where("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    if candidates is not None:
        other = candidates.where("a <> b").join(first.select(F.col("row").alias("a")), "a", "left_semi")
        stars = stars.unionByName(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    edges = verified(stars)

    def apart(edges: DataFrame, bands) -> DataFrame:
        """More edges: in the buckets of some bands, between rows that the edges so far leave apart."""
        found = components(edges).withColumnRenamed("node", "row")
        known = keyed.where(bands).join(found, "row", "left").select("key", "band", "row", F.coalesce("component", "row").alias("c"))
        known = written(known)
        mixed = known.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).where("c1 <> c2")
        mixed = written(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), "n"))
        parts = spread_join(known, mixed, "key", "n", total).withColumn("blk", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int"))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        parts = parts.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), F.col("band").cast("int").alias("band"), "row", "c")
        dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "row")
        sig = first.select("row", "sig")
        order = ["key", "i", "j", "side", "band", "row", "c", "sig"]
        hopeful = dealt(parts.join(sig, "row").select(*order)).mapInArrow(tidy(_hopeful), "key long, i int, j int, side int, band int, row long, c long")
        hopeful = written(hopeful)
        full = hopeful.join(sig.join(sets_of(hopeful.select("row")), "row"), "row").select(*order, "h")
        return written(edges.unionByName(dealt(full).mapInArrow(tidy(_forest(similarity)), "a long, b long")))

    edges = apart(edges, F.col("band") < FIRST_BANDS)
    edges = apart(edges, F.col("band") >= FIRST_BANDS)
    groups = components(written(edges.unionByName(twins))).withColumnRenamed("node", "row")
    return marks.select("row").join(groups, "row", "left").select(F.col("row").alias(row_col), F.coalesce("component", "row").alias("component"))
