"""Benchmark decontamination: an FM-index over each shard of the corpus, searched backwards for the benchmark's word windows.

A shard is what one task has read so far, up to ``shard_words`` words. Its text is the sequence of word numbers; words that
no benchmark item has are separators, and runs too short to hold any window are left out (neither can be part of an
occurrence). Separators count as different, in page order, so prefix doubling ends at the longest run. Ranks come from a wavelet matrix over the Burrows-Wheeler transform; occurrences are located by
walking back to a sampled suffix position; spans of one document are merged by a running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

WINDOW = 10
SAMPLE = 8
SHARD_WORDS = 4_000_000
#: Characters of benchmark text that a task holds at a time; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 4 << 20

# A-Z to lower case; 00-2F, 3A-60 (after A-Z), 7B-7F separate words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view(np.uint64)
            self.words.append(word)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64))))
            on = bit.astype(bool)
            self.zeros.append(int(self.n - on.sum()))
            seq = np.concatenate((seq[~on], seq[on]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at, mask = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at] + np.bitwise_count(self.words[level][at] & mask)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the symbol's path ends at the lowest level; ranks are differences of these."""
        for level in range(self.bits):
            ones = self._ones(level, i)
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and place(symbol, i)."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            symbol = symbol << 1 | bit.astype(np.int64)
            i = np.where(bit.astype(bool), self.zeros[level] + ones, i - ones)
        return symbol, i


class FMIndex:
    """FM-index of a sequence of numbers from 1 to symbols; 0 separates."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate((text.astype(np.int64), [0]))
        n = len(text)
        gap = text == 0
        gaps = int(gap.sum())
        rank = text + (gaps - 1)  # separators differ, in page order: each suffix is settled within its own run
        rank[gap] = np.arange(gaps)
        longest, have = int(np.diff(np.nonzero(gap)[0], prepend=-1).max()), 1
        while have < longest:  # prefixes double
            ahead = np.zeros(n, np.int64)
            ahead[: n - have] = rank[have:]
            key = rank * (int(rank.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank, have = new, have * 2
            if int(rank.max()) == n - 1:
                break
        suffix = np.argsort(rank, kind="stable")
        bwt = text[suffix - 1]
        self.n = n
        self.tree = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # rows that begin with a lower number
        every = np.arange(symbols + 1)
        self.base = self.tree.place(every, np.zeros(symbols + 1, np.int64))
        self.kept = (suffix % sample == 0) | (bwt == 0)  # no walk leaves a run
        self.kept_before = np.concatenate(([0], np.cumsum(self.kept)))
        self.kept_at = suffix[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: a row each, padded behind. Numbers of the phrases found, and their row ranges."""
        alive = np.nonzero(lengths > 0)[0]
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        done = []
        step = 1
        while len(alive):
            at = lengths[alive] - step
            over = at < 0
            if over.any():
                done.append((alive[over], lo[over], hi[over]))
                alive, lo, hi, at = alive[~over], lo[~over], hi[~over], at[~over]
                if not len(alive):
                    break
            c = phrases[alive, at]
            shift = self.first[c] - self.base[c]
            lo, hi = shift + self.tree.place(c, lo), shift + self.tree.place(c, hi)
            ok = (lo < hi) & (c > 0)
            alive, lo, hi, step = alive[ok], lo[ok], hi[ok], step + 1
        if not done:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.kept_at[self.kept_before[rows[hit]]] + walked
            todo, rows = todo[~hit], rows[~hit]
            c, at = self.tree.access(rows)
            rows, walked = self.first[c] + at - self.base[c], walked + 1
        return out


class Windows:
    """The benchmark's windows as rows of word numbers (ordered, distinct), each with the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.ids = window, {}
        names: dict[str | None, int] = {}
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            w = np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in words), np.int32, len(words))
            if len(w) < window:
                w = np.pad(w, (0, window - len(w)))
            part = np.unique(np.lib.stride_tricks.sliding_window_view(w, window), axis=0)
            rows.append(part)
            owner.append(np.full(len(part), names.setdefault(item, len(names)), np.int32))
        every, owner = np.concatenate(rows), np.concatenate(owner)
        order = np.lexsort((owner, *every.T[::-1]))
        every, owner = every[order], owner[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        again = ~new
        again[1:] &= owner[1:] == owner[:-1]  # an item of this id has the window already
        kept = ~again
        self.phrases = every[new]
        self.lengths = (self.phrases > 0).sum(axis=1)
        self.owner = owner[kept]
        self.begin = np.concatenate((np.nonzero(new[kept])[0], [len(self.owner)]))
        self.names = list(names)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def items_of(self, window: int) -> list[str | None]:
        return [self.names[k] for k in self.owner[self.begin[window] : self.begin[window + 1]].tolist()]


class Shard:
    """Documents' words as numbers, without runs too short to hold a window."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.n_words: list[int] = []
        self.parts: list[np.ndarray] = []
        self.total = 0

    def add(self, text: str | None) -> None:
        words = words_of(text)
        get = self.w.ids.get
        self.n_words.append(len(words))
        self.parts.append(np.fromiter((get(x, 0) for x in words), np.int32, len(words)))
        self.total += len(words)

    def results(self, want_spans: bool = False) -> tuple[np.ndarray, list[set[str | None]], list[list[int]]]:
        """For each document: the number of hit words, the items found, and (if wanted) the spans start, end, start, end..."""
        docs = len(self.parts)
        n_hit, items, spans = np.zeros(docs, np.int64), [set() for _ in range(docs)], [[] for _ in range(docs)]
        if not docs or not len(self.w.lengths):
            return n_hit, items, spans
        starts = np.concatenate(([0], np.cumsum(self.n_words)))[:-1]
        gap = np.zeros(1, np.int32)
        seq = np.concatenate([x for p in self.parts for x in (p, gap)])  # a separator after each document
        edge = np.diff(np.concatenate(([0], (seq > 0).astype(np.int8), [0])))
        lo, hi = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = hi - lo >= self.w.shortest
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return n_hit, items, spans
        sizes = hi - lo + 1  # with a separator behind
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
        text = seq[at]
        text[np.cumsum(sizes) - 1] = 0
        index = FMIndex(text, len(self.w.ids))
        which, first, last = index.search(self.w.phrases, self.w.lengths)
        if not len(which):
            return n_hit, items, spans
        many = last - first
        window = np.repeat(which, many)
        rows = np.repeat(first - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
        pos = index.locate(rows)
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + self.w.lengths[window], -1)
        hit = np.cumsum(cover)[:-1] > 0
        begin = starts + np.arange(docs)  # of each document in seq
        doc = np.searchsorted(begin, at, side="right") - 1
        n_hit += np.bincount(doc[hit], minlength=docs)
        pair = np.unique(doc[pos] * len(self.w.lengths) + window)
        for d, w in zip((pair // len(self.w.lengths)).tolist(), (pair % len(self.w.lengths)).tolist(), strict=True):
            items[d].update(self.w.items_of(w))
        if want_spans:
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            for a, b in zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist(), strict=True):
                d = int(doc[a])
                spans[d] += [int(at[a] - begin[d]), int(at[b] - begin[d]) + 1]
        return n_hit, items, spans


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size (a longer item is one of its own), streamed to the driver by partition."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        n = len(text or "")
        if size and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


class _Sent:
    """A broadcast value that neither the driver nor a worker keeps after it was used."""

    def __init__(self, sc, value):
        self.sent = sc.broadcast(value)
        vars(self.sent).pop("_value", None)

    def get(self):
        return self.sent.value

    def drop(self) -> None:
        vars(self.sent).pop("_value", None)  # read again from the worker's file when needed


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, with_spans: bool = False, keep: bool = False) -> DataFrame:
    """Adds n_words, n_hit, items (sorted item ids as strings), n_items, items_sha256, contaminated, and spans if asked for.

    Nulls and texts without words have n_words 0 and no hits; null item texts make no windows; items with a null id have
    windows and count as one item, which items and items_sha256 don't name; repeated items count once; repeated document rows
    are judged row by row; an empty benchmark hits nothing; other columns of docs are dropped unless keep, and then those
    named like added ones give way. Spans are word offsets start, end (exclusive), flattened and merged. The benchmark is
    sent in blocks of block_bytes: one pass over the corpus searches all blocks, one after another, and a worker holds one of
    them at a time (and the files that Spark keeps of all on its disk).
    """
    spark = docs.sparkSession
    blocks = [_Sent(spark.sparkContext, Windows(b, window)) for b in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    added = {"n_words": "long", "n_hit": "long", "items": "array<string>", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"} | ({"spans": "array<long>"} if with_spans else {})
    base = docs if keep else docs.select(id_col, text_col)
    base = base.drop(*[c for c in base.columns if c.lower() in added])
    kept = [f for f in base.schema.fields if keep or f.name != text_col]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", {k} {v}" for k, v in added.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for part in slices(batch, text_col):
                rows.append(part)
                total += part.column(text_col).nbytes // 6
                if total >= shard_words:
                    yield from judged(rows)
                    rows, total = [], 0
        yield from judged(rows)

    def judged(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        texts = [t for r in rows for t in r.column(text_col).to_pylist()]
        hits = [np.zeros(len(texts), np.int64), [set() for _ in texts], [[] for _ in texts]]
        for b in blocks:
            shard = Shard(b.get())
            for t in texts:
                shard.add(t)
            n_hit, items, spans = shard.results(with_spans or len(blocks) > 1)
            if len(blocks) == 1:
                hits = [n_hit, items, spans]
                break
            for d in np.nonzero(n_hit)[0].tolist():
                hits[1][d] |= items[d]
                hits[2][d] = _merged(hits[2][d] + spans[d])
                hits[0][d] = sum(hits[2][d][1::2]) - sum(hits[2][d][::2])
            b.drop()
            shard.w = None
        named = [sorted(x - {None}) for x in hits[1]]
        n_words = shard.n_words
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
        cols = {n: pa.concat_arrays([r.column(n) for r in rows]) for n in names}
        cols |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(hits[0], pa.int64()), "items": pa.array(named, pa.list_(pa.string())), "n_items": pa.array([len(x) for x in hits[1]], pa.int64()), "items_sha256": pa.array(digest, pa.string()), "contaminated": pa.array(hits[0] > 0, pa.bool_())}
        if with_spans:
            cols["spans"] = pa.array(hits[2], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return base.mapInArrow(tidy(run), schema)


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


ORACLE_OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, ks, unnest(range(1, greatest(1, len(w) - k + 2))) AS t(i)),
h AS (SELECT doc_id, item_id, k, i FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) AS t(p) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) + max((item_id IS NULL)::INT) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS a FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(a, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
