"""SimHash near-duplicate groups, with pigeonring filtering of candidate pairs.

64 bits are cut into five segments on a ring. If two fingerprints differ in at most 4 bits, some start on the ring has
every chain of l consecutive segments from it differing in at most floor(4 l / 5) bits (the strong pigeonring principle):
none in the first segment, at most 1 in the first two, 2 in three, 3 in four, 4 in all. The first two conditions make the
index key: the start segment and the next but for one of its parts (with at most one bit off, the others are equal). There are
two parts, or more for very many fingerprints, as keys are longer then and their buckets stay small. The further chains are
checked before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread_join, table, tidy, written
from .graph import components

BITS, SEGMENTS, DISTANCE, SHINGLE = 64, 5, 4, 4
WIDTHS = (13, 13, 13, 13, 12)
#: Rows of one key that one task compares; a larger bucket is compared block by block in several tasks.
BLOCK = 2048
#: Parts of the next segment, and rows of a bucket on average from which the next larger number is taken.
PARTS, BUCKET = (2, 3, 4, 6, 12), 256
#: So many oversized keys are broadcast at most; more are joined by a shuffle.
MAX_HOT = 100_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
_MASKS = tuple(np.uint64(((1 << w) - 1) << s) for w, s in zip(WIDTHS, _SHIFTS, strict=True))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values (seed 42) of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(_FOLD).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(words), 42)
    columns = [words[i : n + i] for i in range(shingle)]
    h = np.fromiter((xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*columns, strict=True))), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for part in range(0, n, 1 << 16):
        bits = np.unpackbits(h[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(ones * 2 > n)[0].tolist()))


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without the text, with fp: the fingerprint as a signed long. Null texts have fingerprint zero."""
    kept = [c for c in docs.columns if c != text_col and c.lower() != "fp"]
    base = docs.select(*kept, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != text_col) + ("," if kept else "") + " fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                fp = np.array([fingerprint(t, shingle) for t in part.column(text_col).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(fp)], names=[*kept, "fp"])

    return base.mapInArrow(tidy(run), schema)


def parts_for(fingerprints: int) -> int:
    """Into how many parts the next segment is cut: 10 keys of 18 bits a fingerprint up to 6e7 of them, 60 of 23 bits from 1e9 on."""
    fits = [p for p in PARTS if fingerprints <= BUCKET * 2 ** (12 + 12 * (p - 1) / p)]
    return fits[0] if fits else PARTS[-1]


def _keys(parts: int = PARTS[0]) -> list:
    """Index keys of a fingerprint: for each start segment and each part of the next that may differ, a long with their
    number, the segment, and the next one without the part."""
    out = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        segment = F.shiftrightunsigned("fp", _SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))
        cuts = [WIDTHS[j] * k // parts for k in range(parts + 1)]
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rest = ((1 << WIDTHS[j]) - 1) & ~((1 << hi) - (1 << lo))
            bits = F.shiftrightunsigned("fp", _SHIFTS[j]).bitwiseAND(F.lit(rest))
            out.append(F.shiftleft(F.lit(parts * i + part).cast("long"), 40).bitwiseOR(F.shiftleft(segment, 16)).bitwiseOR(bits))
    return out


def pigeonring_ok(x: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which differences (xor values) have a start from which every chain keeps its share, and at most `distance` bits in all."""
    b = np.stack([np.bitwise_count(x & m) for m in _MASKS]).astype(np.int16)
    total = b.sum(axis=0)
    ok = np.zeros(len(x), bool)
    for i in range(SEGMENTS):
        good, chain = np.ones(len(x), bool), np.zeros(len(x), np.int16)
        for l in range(1, SEGMENTS):
            chain = chain + b[(i + l - 1) % SEGMENTS]
            good &= chain <= distance * l // SEGMENTS
        ok |= good
    return ok & (total <= distance)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _forest(group: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what linked pairs of one group join; each row is compared with the rows behind it in its group."""
    n, bits = len(fp), fp.view(np.uint64)
    values, index = np.unique(fp, return_inverse=True)
    parent = np.arange(len(values))
    left, right = [], []
    alive = np.arange(n)
    shift = 1
    while True:
        alive = alive[alive + shift < n]
        alive = alive[group[alive] == group[alive + shift]]
        if not len(alive):
            break
        at = alive[np.bitwise_count(bits[alive] ^ bits[alive + shift]) <= distance]
        at = at[(side[at] != side[at + shift]) | (i[at] == j[at])]
        at = at[_roots(parent, index[at]) != _roots(parent, index[at + shift])]
        at = at[pigeonring_ok(bits[at] ^ bits[at + shift], distance)]
        for x, y in zip(index[at].tolist(), index[at + shift].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(x)
                right.append(y)
        shift += 1
    return values[left], values[right]


def _linked(distance: int):
    """For mapInArrow over rows (key, i, j, side, fp) sorted by (key, i, j): edges between linked fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "fp")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            n = len(cols[0])
            if n:
                key, i, j = cols[:3]
                cut = n - int(((key == key[-1]) & (i == i[-1]) & (j == j[-1])).sum())  # the last group may go on in the next batch
                yield from found([c[:cut] for c in cols])
                rest = [c[cut:] for c in cols]
        if rest is not None:
            yield from found(rest)

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, i, j, side, fp = cols
        if len(key) > 1:
            group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            left, right = _forest(group, i, j, side, fp, distance)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_edges(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS[0]) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect exactly what pairs within the distance connect.

    Five key rows a part for each fingerprint are grouped by key and compared inside the task, vectorised over all its buckets, so
    candidate pairs never become rows; only a spanning forest leaves. A bucket over BLOCK rows is cut into blocks by a hash
    of the fingerprint, and each pair of blocks is one group that may go to any task.
    """
    if distance != DISTANCE:
        raise ValueError("the segments are laid out for a distance of 4")
    keyed = fps.select("fp", F.explode(F.array(*_keys(parts))).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    hot = written(hot)
    small = F.broadcast(hot) if hot.count() <= MAX_HOT else hot
    cold_rows = keyed.join(small, "key", "left_anti")
    cold = cold_rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nb")).cast("int")
    parts = keyed.join(small, "key").withColumn("blk", block).select("key", "fp", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    split = parts.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "fp")
    rows = cold.unionByName(split).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(tidy(_linked(distance)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """For every row its id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable over links, itself
    included) and n_members (rows in the component).

    Null and wordless texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle are one
    shingle; repeated ids keep one row each; rows with a null id get a fingerprint and the smallest non-null id of their
    component (null if there is none); an empty table gives no rows.
    """
    marks = written(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")), "text", shingle))
    fps = written(marks.groupBy("fp").agg(F.min("_id").alias("low"), F.count("*").alias("n")))
    links = components(near_edges(fps.select("fp"), distance, parts_for(fps.count()))).withColumnRenamed("node", "fp")
    grouped = written(fps.join(links, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    low = written(grouped.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_members"), F.count("*").alias("k")))
    classes = written(spread_join(grouped.select("fp", "component", "n"), low, "component", "k", grouped.count()).select("fp", "component_id", "n_members", "n"))
    out = spread_join(marks, classes, "fp", "n", marks.count())
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_members")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
