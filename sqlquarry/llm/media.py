"""Copies of images by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming tables and
geometric consensus, for a column of encoded images (binary PGM or PPM, or 8-bit PNG).

Every image is indexed and every image is a query. Rows of equal features are one picture. Each descriptor gives a row for
each Hamming table, keyed by some bits of one of its two words; rows of a key meet in one task and are compared by the other
word there, so only pairs of pictures leave it. A pair of pictures is then judged on all their corners: matches within 15
bits, of which enough agree on one turn, scale and shift.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, salted_join, sized, slices, spread_join, table, tidy, written
from .graph import components

BITS, RADIUS, DISTANCE = 128, 15, 15
SCALES = tuple(0.8**k for k in range(5))
#: Corners that agree on one turn, scale and shift.
MIN_INLIERS = 6
#: Hamming tables, and bits of a key. The same for every input, so that a pair's meetings depend on its two pictures alone.
TABLES, KEY_BITS = 4, 40
#: Times that a pair of pictures meets in the tables at least to be judged; edited copies of op5's pictures met eight times or more.
MIN_MEETINGS = 2
#: Rows of one key that one task compares; a larger bucket is compared block by block in several tasks.
BLOCK = 4096
#: Rows of a bucket of which all pairs are taken at once.
FEW = 4
#: A key is looked at as a large one if it has COMMON of some CHUNK descriptors of a task.
CHUNK, COMMON = 1 << 18, 16


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values as floats, or None if the bytes are no image of a known kind."""
    try:
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            w, h, _ = fields
            c = 1 if data[:2] == b"P5" else 3
            return np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c).mean(axis=2)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except Exception:  # noqa: BLE001  any damage: not an image
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, colour, _, _, lace = head
    c = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or c is None or lace:
        return None
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        up = out[y - 1] if y else np.zeros(w * c, np.int64)
        if kind == 2:
            line = line + up
        elif kind:
            for x in range(w * c):
                a, b = (line[x - c] if x >= c else 0), up[x]
                d = up[x - c] if x >= c else 0
                p = a + b - d
                pick = a if kind == 1 else (a + b) // 2 if kind == 3 else min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
                line[x] = (line[x] + pick) & 255
        out[y] = line & 255
    return out.reshape(h, w, c)[:, :, : 3 if c > 2 else 1].mean(axis=2)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k])[: a.shape[0], : a.shape[1]] / k**2


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    if scale == 1.0 or min(h, w) < 2:
        return a
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 2), np.minimum(x.astype(int), a.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx
    low = a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


_RNG = np.random.default_rng(1234)
_TESTS = np.clip(_RNG.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS + 4, RADIUS - 4)
_YX = np.mgrid[-7:8, -7:8].reshape(2, -1)
_YX = _YX[:, (_YX**2).sum(axis=0) <= 49]


@dataclass
class Features:
    """x, y, log scale, angle of each corner, and its descriptor as two 64-bit words."""

    where: np.ndarray
    bits: np.ndarray


def features(image: np.ndarray | None) -> Features:
    where, bits = [np.zeros((0, 4))], [np.zeros((0, 2), np.uint64)]
    for scale in SCALES if image is not None and min(image.shape) >= 8 else ():
        a = _box(_resized(image, scale), 1)
        if min(a.shape) < 8:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        p = np.pad(r, 2, constant_values=-np.inf)
        top = np.max([p[i : i + r.shape[0], j : j + r.shape[1]] for i in range(5) for j in range(5)], axis=0)
        y, x = np.nonzero((r == top) & (r > 50))
        if not len(y):
            continue
        pad = np.pad(a, RADIUS + 8, mode="edge")
        cy, cx = y + RADIUS + 8, x + RADIUS + 8
        patch = pad[cy[:, None] + _YX[0], cx[:, None] + _YX[1]]
        angle = np.arctan2((patch * _YX[0]).sum(axis=1), (patch * _YX[1]).sum(axis=1))
        s, c = np.sin(angle)[:, None], np.cos(angle)[:, None]
        at = lambda ty, tx: pad[np.rint(cy[:, None] + ty * c + tx * s).astype(int), np.rint(cx[:, None] + tx * c - ty * s).astype(int)]
        test = at(_TESTS[:, 0], _TESTS[:, 1]) < at(_TESTS[:, 2], _TESTS[:, 3])
        bits.append(np.packbits(test, axis=1, bitorder="little").view(np.uint64))
        where.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), -np.log(scale)), angle], axis=1))
    return Features(np.concatenate(where), np.concatenate(bits))


#: Bits of a word that make up the key of each table; the two highest hold the table's number.
_MASKS = [np.bitwise_or.reduce(np.uint64(1) << np.random.default_rng(400 + t).permutation(62)[:KEY_BITS].astype(np.uint64)) for t in range(TABLES)]


def table_keys(bits: np.ndarray) -> np.ndarray:
    """Keys of descriptors (a row each): one for each table."""
    return np.stack([(bits[:, t % 2] & mask) | np.uint64(t << 62) for t, mask in enumerate(_MASKS)], axis=1).view(np.int64)


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """The most corners of a that one turn, scale and shift (each match proposes its own) carries onto their partners in b;
    or a number from `enough` on, as soon as a proposal has it."""
    turn, size = b[:, 3] - a[:, 3], np.exp(b[:, 2] - a[:, 2])
    c, s = np.cos(turn) * size, np.sin(turn) * size
    best = 0
    for k in range(len(a)):
        x = c[k] * a[:, 0] - s[k] * a[:, 1]
        y = s[k] * a[:, 0] + c[k] * a[:, 1]
        off = np.hypot(x - x[k] + b[k, 0] - b[:, 0], y - y[k] + b[k, 1] - b[:, 1])
        spun = np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi)
        ok = (off < 3.0 * max(1.0, size[k])) & (spun < 0.35) & (np.abs(np.log(size / size[k])) < 0.25)
        if ok.sum() > best:
            best = max(best, min(len(np.unique(a[ok, :2], axis=0)), len(np.unique(b[ok, :2], axis=0))))
        if enough and best >= enough:
            break
    return best


def matches(a: Features, b: Features) -> tuple[np.ndarray, np.ndarray]:
    """Corners (of a, of b) with descriptors within DISTANCE bits."""
    i, j = np.nonzero(np.bitwise_count(a.bits[:, :1] ^ b.bits[:, 0]) <= DISTANCE)
    x, y = a.bits[i], b.bits[j]
    near = np.bitwise_count(x[:, 0] ^ y[:, 0]) + np.bitwise_count(x[:, 1] ^ y[:, 1]) <= DISTANCE
    return i[near], j[near]


def copied(a: Features, b: Features) -> bool:
    """Whether one picture is a cropped or edited copy of the other."""
    i, j = matches(a, b)
    return len(i) >= MIN_INLIERS and consensus(a.where[i], b.where[j], MIN_INLIERS) >= MIN_INLIERS


def _unpacked(where: bytes, bits: bytes) -> Features:
    return Features(np.frombuffer(where, "<f4").reshape(-1, 4).astype(float), np.frombuffer(bits, "<u8").reshape(-1, 2))


def _counted(kind: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct rows of columns, and how often each is there."""
    order = np.lexsort(kind)
    kind = [x[order] for x in kind]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in kind], axis=0)
    first = np.nonzero(new)[0]
    return *(x[first] for x in kind), np.diff(np.append(first, len(order)))


def _meetings(apart: bool, hot: bool):
    """For mapInArrow over rows (key, i, j, side, row, c, word) sorted by key, blocks and row: pairs of pictures that meet in
    keys with words within DISTANCE bits, and how often; of two blocks only those across.

    A bucket is large if it has over FEW rows, or is cut into blocks (hot). First, small ones give all their pairs (n), and
    large ones those of each row with the first: how often they meet (m), and 1 in hub, also if never. Then (apart) the large
    ones come again with the class c of each picture, and give all pairs between classes (n).
    """

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, i, j, side, row, c, word = cols
        new = np.ones(len(row), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.nonzero(new)[0]
        size = np.diff(np.append(first, len(row)))
        large = np.repeat((size > FEW) | hot, size)
        first, word, same = np.repeat(first, size), word.view(np.uint64), i == j
        left, right, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]

        def meet(x: np.ndarray, y: np.ndarray, every: bool = False) -> None:
            ok = (np.bitwise_count(word[x] ^ word[y]) <= DISTANCE) & ((side[x] != side[y]) | same[x])
            some = (row[x] != row[y]) & (ok | every)
            if apart:
                some &= c[x] != c[y]
            left.append(np.minimum(row[x[some]], row[y[some]]))
            right.append(np.maximum(row[x[some]], row[y[some]]))
            met.append(ok[some])

        alive, shift = np.nonzero(large == apart)[0], 1
        while len(alive):
            alive = alive[alive + shift < len(row)]
            alive = alive[first[alive] == first[alive + shift]]
            meet(alive, alive + shift)
            shift += 1
        n_all = sum(map(len, left))
        if not apart:
            here = np.nonzero(large & ~new)[0]
            meet(here, first[here], every=True)
        a, b, met = np.concatenate(left), np.concatenate(right), np.concatenate(met)
        hub = np.arange(len(a)) >= n_all
        a, b, met, hub, n = _counted([a, b, met, hub])
        if len(n):
            cols = a, b, n * ~hub, n * (hub & met), hub
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["a", "b", "n", "m", "hub"])

    return lambda batches: _whole_groups(batches, found)


def _whole_groups(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = len(cols[0]) - int(np.all([g == g[-1] for g in cols[:3]], axis=0).sum())  # the last group may go on in the next batch
        if cut:
            yield from found([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None:
        yield from found(rest)


def hot_keys(pictures: DataFrame) -> DataFrame:
    """Keys of over BLOCK rows of pictures (bits), and the number of blocks (nb) that each is cut into."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(table_keys(np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)), return_counts=True)
            many = n >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(n[many], pa.int64())], names=["key", "n"])

        for batch in batches:
            for b in batch.column("bits").to_pylist():
                held.append(b)
                size += len(b) // 16
                if size >= CHUNK:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    counts = pictures.select("bits").mapInArrow(tidy(common), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return written(counts.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")))


def meetings(pictures: DataFrame, hot: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of rows of pictures (row, bits) that meet in the Hamming tables, with how often in small buckets (n) and
    with the first of a large one (m), and whether one is the first of a large bucket with the other in it (hub). With mixed
    (key): of pictures (row, bits, c) those between classes in large buckets of these keys (n)."""
    apart = mixed is not None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bits", 1 << 20):
                bits = part.column("bits").to_pylist()
                per = [len(b) // 16 * TABLES for b in bits]
                own = np.frombuffer(b"".join(bits), "<u8").reshape(-1, 2)
                words = np.stack([own[:, 1 - t % 2] for t in range(TABLES)], axis=1)
                of = [np.repeat(part.column(k).to_numpy(), per) for k in ("row", "c")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table_keys(own).ravel(), *of, words.ravel().view(np.int64))], names=["key", "row", "c", "word"])

    of = pictures.select("row", "c" if apart else F.lit(0).cast("long").alias("c"), "bits")
    rows = of.mapInArrow(tidy(keyed), "key long, row long, c long, word long")
    if apart:
        rows = rows.join(sized(mixed), "key", "left_semi")
    n_hot = hot.count()
    cold = rows.join(sized(hot), "key", "left_anti") if n_hot else rows
    dealt = cold.repartition("key").sortWithinPartitions("key", "row").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "row", "c", "word")
    out = "a long, b long, n long, m long, hub long"
    pairs = dealt.mapInArrow(tidy(_meetings(apart, False)), out)
    if n_hot:
        split = rows.join(sized(hot), "key").withColumn("blk", F.pmod(F.xxhash64("row", "word"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        split = split.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "row", "c", "word")
        pairs = pairs.unionByName(split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "row").mapInArrow(tidy(_meetings(apart, True)), out))
    return written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("hub").alias("hub")))


def copies(images: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """For every row media_id, readable, n_corners, class_id (smallest media_id reachable over links, its own included) and
    class_size (rows of the class). Links are between a picture and its cropped, edited and equal copies.

    All corners over the response threshold count. Null, damaged and unknown images (JPEG among them) are not readable; they
    and pictures of fewer than MIN_INLIERS corners are linked only with rows of the very same bytes, nulls with none. A null
    id is kept; its class has the smallest id that is not null, or null; repeated rows are each other's copies; an empty table
    gives no rows; other columns are dropped. Links are found by Hamming tables (recall against all pairs is tested)
    and are exact once found. In a large group of copies not all pairs are judged, but those that can join classes.
    """
    base = images.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).cast("binary").alias("image")).withColumn("row", F.monotonically_increasing_id())

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, image in zip(batch.column("row").to_pylist(), batch.column("image").to_pylist(), strict=True):
            pixels = decode_image(image)
            f = features(pixels)
            where, bits = f.where.astype("<f4").tobytes(), f.bits.astype("<u8").tobytes()
            content = where + bits if len(f.bits) >= MIN_INLIERS else str(row).encode() if image is None else b"=" + image
            out.append((pixels is not None, len(f.bits), where, bits, blake2b(content, digest_size=16).digest()))
        cols = list(zip(*out, strict=True))
        kinds = [pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["media_id", "row", "readable", "n_corners", "where", "bits", "same"])

    every = written(base.mapInArrow(map_slices(described, "image"), "media_id long, row long, readable boolean, n_corners int, where binary, bits binary, same binary"))
    groups = written(every.groupBy("same").agg(F.min("row").alias("node"), F.min("media_id").alias("low"), F.count("*").alias("n"), F.min("n_corners").alias("c")))
    pictures = every.join(sized(groups.where(F.col("c") >= MIN_INLIERS).select(F.col("node").alias("row"))), "row", "left_semi").select("row", "where", "bits")
    side = lambda p: pictures.select(F.col("row").alias(p), F.col("where").alias(p + "w"), F.col("bits").alias(p + "b"))

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [copied(_unpacked(aw, ab), _unpacked(bw, bb)) for aw, ab, bw, bb in zip(*(batch.column(c).to_pylist() for c in ("aw", "ab", "bw", "bb")), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.intersect1d(*(table_keys(np.frombuffer(x, "<u8").reshape(-1, 2)) for x in pair)) for pair in zip(batch.column("ab").to_pylist(), batch.column("bb").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)))], names=["key"])

    def sides(pairs: DataFrame) -> DataFrame:
        both = salted_join(salted_join(pairs, side("a"), "a", pairs), side("b"), "b", pairs)
        return both.select("a", "b", "aw", "ab", "bw", "bb")

    links = lambda pairs: written(sides(pairs).mapInArrow(map_slices(judged, "ab"), "a long, b long"))
    hot = hot_keys(pictures)
    met = meetings(pictures, hot)
    edges = links(written(met.where(F.col("n") + F.col("m") >= MIN_MEETINGS).select("a", "b")))
    hubs = met.where("hub > 0").select("a", "b")
    if hubs.take(1):
        # a large bucket of several classes has a row of another class than its first
        named = written(pictures.select("row").join(sized(components(edges).select(F.col("node").alias("row"), F.col("component").alias("c"))), "row", "left").select("row", F.coalesce("c", "row").alias("c")))
        of = lambda p: named.select(F.col("row").alias(p), F.col("c").alias(p + "c"))
        across = salted_join(salted_join(hubs, of("a"), "a", hubs), of("b"), "b", hubs)
        across = written(across.where("ac <> bc").select("a", "b"))
        if across.take(1):
            mixed = written(sides(across).mapInArrow(map_slices(shared, "ab"), "key long").distinct())
            more = meetings(pictures.join(named, "row"), hot, mixed).select("a", "b", F.col("n").alias("k"))
            more = more.join(met, ["a", "b"], "left").where(F.coalesce("n", F.lit(0)) + F.col("k") >= MIN_MEETINGS).where(F.coalesce(F.col("n") + F.col("m"), F.lit(0)) < MIN_MEETINGS)
            edges = written(edges.unionByName(links(written(more.select("a", "b")))))
    grouped = groups.join(components(edges), "node", "left")
    grouped = written(grouped.select("same", "low", "n", F.coalesce("component", "node").alias("component")))
    classes = written(grouped.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("k")))
    known = written(spread_join(grouped.select("same", "n", "component"), classes, "component", "k", groups.count()).select("same", "n", "class_id", "class_size"))
    out = spread_join(every.select("media_id", "readable", "n_corners", "same"), known, "same", "n", every.count())
    return out.select("media_id", "readable", "n_corners", "class_id", "class_size")


#: Cells of a rendered picture in a row, and pixels of a cell.
CELLS, PIXELS = 16, 4
_SHADES = np.random.default_rng(64).normal(0, 1, (CELLS * CELLS, 64))


def rendered(embedding: list[float] | None) -> bytes | None:
    """A stand-in for stored media, as the tables have none: a mosaic whose cells are fixed projections of the vector, as PGM.
    Like vectors have like pictures."""
    if embedding is None or len(embedding) != 64:
        return None
    v = np.nan_to_num(np.asarray(embedding, float))
    grey = np.clip(np.rint(128 + 60 * (_SHADES @ v) / max(1e-9, float(np.linalg.norm(v)))), 0, 255).astype(np.uint8).reshape(CELLS, CELLS)
    return b"P5 %d %d 255\n" % (CELLS * PIXELS, CELLS * PIXELS) + np.kron(grey, np.ones((PIXELS, PIXELS), np.uint8)).tobytes()


def edited(image: bytes | None, seed: int) -> bytes | None:
    """A crop or an edit of an image, chosen by the seed: cropped, turned and brightened, rescaled, blurred, or noisy."""
    a = decode_image(image)
    if a is None:
        return image
    kind, rng = seed % 5, np.random.default_rng(seed)
    if kind == 0:
        h, w = (int(x * 0.75) for x in a.shape)
        y, x = int(rng.integers(0, a.shape[0] - h + 1)), int(rng.integers(0, a.shape[1] - w + 1))
        a = a[y : y + h, x : x + w]
    elif kind == 1:
        a = np.rot90(a) * 0.9 + 8
    elif kind == 2:
        a = _resized(a, 0.8)
    elif kind == 3:
        a = _box(a, 1)
    else:
        a = a + rng.normal(0, 4, a.shape)
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def media_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column that op5 works on: every embedding rendered; but rows whose id divided by 8 leaves 3 have a crop or an
    edit of the picture of the row three ids before."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("media_id"), "embedding")
    source = base.where("media_id % 8 = 0").groupBy(F.col("media_id").alias("source")).agg(F.min("embedding").alias("original"))
    of = F.when(F.col("media_id") % 8 == 3, F.col("media_id") - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for i, e, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                images.append(rendered(e) if o is None else edited(rendered(o), i // 8))
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(images, pa.binary())], names=["media_id", "image"])

    copied_rows = base.where("media_id % 8 = 3").join(source, F.col("source") == of, "left").select("media_id", "embedding", "original")
    own = base.where("media_id IS NULL OR media_id % 8 <> 3").withColumn("original", F.lit(None).cast("array<float>"))
    return own.unionByName(copied_rows).mapInArrow(tidy(run), "media_id long, image binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(media_table(spark, sf_dir))
