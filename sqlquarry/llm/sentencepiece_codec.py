"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A run is the text from one space to the next; no piece has a space inside, so the lattice of a text is the product of its
runs' lattices. For each distinct run, forward filtering sums the weights of all paths to each position; backward sampling
then draws, from the end, the piece that a path ends with, in proportion to what filtering found. The draws of all runs of a
batch advance together, one piece a step. Each draw's number is a hash of the seed, the row's key, the run's place in the
row and the step, so a row's segmentation is the same wherever and whenever it is sampled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table
from .token_counts import SPACE, model_bytes, read_pieces

#: Weight of a piece is exp(ALPHA * score - BETA); larger ALPHA is nearer to the best-scored path.
ALPHA, BETA, SEED = 3e-4, 2.0, 7
#: Runs and lattice edges that a worker keeps; it starts anew when full.
MEMO, MEMO_EDGES = 75_000, 1_000_000
#: Bytes of text that are encoded at a time: the tables of a slice's new runs are many times its size.
SLICE = 1 << 18
_RUNS = re.compile(" *[^ ]+| +")
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BASE, _WORD = 0x100000001B3 * 2 + 1, (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(_GOLDEN) >> np.uint64(44)).astype(np.int64)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[_slot(keys)] = True
    return out


def _running(x: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums within segments (begin, length), each added from its own start, so that no segment depends on another."""
    out = x.copy()
    for k in range(1, int(n.max(initial=0))):
        at = begin[n > k] + k
        out[at] += out[at - 1]
    return out


class Lattice:
    """Piece lattices of runs, as flat tables: a node for each (run, end position), an edge for each piece ending there."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float, alpha: float = ALPHA, beta: float = BETA):
        # a space is a space; the sign that stands for it is spelt in bytes where a text has it
        self.byte_ids, self.byte_weight = np.array(byte_ids, np.int32), alpha * byte_score - beta
        self.tables: dict[int, bytes] = {b: bytes([k]) for k, b in enumerate(byte_ids)}
        self.weight: dict[str, float] = {}
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        prefixes: dict[int, set[int]] = {}
        for p, (i, s) in pieces.items():
            p = p.replace(SPACE, " ")
            self.tables[i] = p.encode()
            self.weight[p] = w = alpha * s - beta
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * _BASE + ord(c) + 1) & _WORD
                if n < len(p):
                    prefixes.setdefault(n, set()).add(h)
            by_length.setdefault(len(p), []).append((h, i, w))
        self.longest = max(by_length, default=1)
        self.known, self.prefix, self.maybe = {}, {n: _bitmap(np.array(sorted(v), np.uint64)) for n, v in prefixes.items()}, {}
        for n, rows in by_length.items():
            rows.sort()
            assert len({r[0] for r in rows}) == len(rows), "two pieces of one length share a hash"
            self.known[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])
            self.maybe[n] = _bitmap(self.known[n][0])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # run -> its last node
        self.first = np.zeros(1, np.int64)  # of each node, the first edge; one more at the end
        self.cum = np.zeros(0)  # share of this edge and those before it at its node; over 1 at the last
        self.back = np.zeros(0, np.int32)  # nodes back to the edge's start; 0: the run's start
        self.ids = np.zeros(0, np.int32)  # the piece; -1 - c: the bytes of character c

    def matches(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of all runs: start character, last character, piece, weight. stop: the end of each character's run."""
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        found = []
        for n in range(1, self.longest + 1):
            inside = at + n <= stop[at]
            at, h = at[inside], h[inside]
            h = h * np.uint64(_BASE) + chars[at + n - 1] + np.uint64(1)
            if n in self.known:
                keys, ids, weights = self.known[n]
                some = np.nonzero(self.maybe[n][_slot(h)])[0]
                k = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                hit = keys[k] == h[some]
                some, k = some[hit], k[hit]
                found.append((at[some], at[some] + n - 1, ids[k], weights[k]))
            if n == 1:
                miss = np.delete(at, some) if n in self.known else at
                c = chars[miss].astype(np.int64)
                found.append((miss, miss, (-1 - c).astype(np.int32), self.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))
            if n not in self.prefix:
                break
            more = self.prefix[n][_slot(h)]  # a false one only costs a look
            at, h = at[more], h[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def add(self, runs: list[str]) -> None:
        """Forward filtering over new runs, all at once: position by position."""
        chars = np.frombuffer("".join(runs).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        sizes = np.array([len(r) for r in runs])
        stops = np.cumsum(sizes)
        stop = np.repeat(stops, sizes)
        offset = np.arange(len(chars)) - np.repeat(stops - sizes, sizes)
        start, end, ids, weight = self.matches(chars, stop)
        order = np.argsort(end * 64 + (start - end + 63), kind="stable")  # by end, longest first
        start, end, ids, weight = start[order], end[order], ids[order], weight[order]
        first = np.searchsorted(end, np.arange(len(chars)))
        value = weight.copy()
        total = np.zeros(len(chars))
        inner = offset[start] > 0
        many = np.diff(np.append(first, len(end)))
        nodes = np.argsort(offset, kind="stable")
        bounds = np.cumsum(np.bincount(offset))
        for lo, hi in zip(np.concatenate(([0], bounds[:-1])).tolist(), bounds.tolist(), strict=True):
            here = nodes[lo:hi]
            n = many[here]
            begin = np.cumsum(n) - n
            e = np.repeat(first[here] - begin, n) + np.arange(n.sum())
            v = value[e] + np.where(inner[e], total[start[e] - 1], 0.0)
            value[e] = v
            top = np.maximum.reduceat(v, begin)
            total[here] = top + np.log(_running(np.exp(v - np.repeat(top, n)), begin, n)[begin + n - 1])
        cum = _running(np.exp(value - total[end]), first, many)
        cum[first + many - 1] = 2.0
        nodes_before, edges_before = len(self.first) - 1, len(self.cum)
        self.at.update(zip(runs, (stops - 1 + nodes_before).tolist(), strict=True))
        self.first = np.concatenate((self.first[:-1], first + edges_before, [edges_before + len(end)]))
        self.cum = np.concatenate((self.cum, cum))
        self.back = np.concatenate((self.back, np.where(inner, end - start + 1, 0).astype(np.int32)))
        self.ids = np.concatenate((self.ids, ids))

    def lookup(self, runs: list[str]) -> np.ndarray:
        """The last node of each run; new runs are compiled first."""
        if len(self.at) > MEMO or len(self.cum) > MEMO_EDGES:
            self.clear()
        new = [r for r in dict.fromkeys(runs) if r not in self.at]
        if new:
            self.add(new)
        return np.fromiter(map(self.at.__getitem__, runs), np.int64, len(runs))

    def sample(self, last: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all runs at once. draw: a number for each run. Piece numbers in order, and how many each run has."""
        n = len(last)
        count = np.zeros(n, np.int64)
        who, node, found = np.arange(n), last, []
        step = 0
        while len(who):
            u = (_mixed(draw[who] + np.uint64(step * _GOLDEN & _WORD)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = self.first[node]
            past = np.nonzero(self.cum[at] <= u)[0]
            while len(past):
                at[past] += 1
                past = past[self.cum[at[past]] <= u[past]]
            found.append((who, self.ids[at]))
            count[who] += 1
            back = self.back[at]
            go = back > 0
            who, node = who[go], node[go] - back[go]
            step += 1
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for step, (who, piece) in enumerate(found):
            out[begin[who] + count[who] - 1 - step] = piece
        return out, count

    def spelt(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers with characters that are no pieces spelt in bytes, and where each of `pieces` begins in them."""
        odd = np.nonzero(pieces < 0)[0]
        sizes = np.ones(len(pieces), np.int64)
        codes, which = np.unique(-1 - pieces[odd].astype(np.int64), return_inverse=True)
        raw = [chr(c).encode("utf-8", "replace") for c in codes.tolist()]
        length = np.array([len(r) for r in raw], np.int64)
        sizes[odd] = length[which] if len(odd) else 0
        begin = np.concatenate(([0], np.cumsum(sizes)))
        wide = np.repeat(pieces, sizes)
        if len(odd):
            table = self.byte_ids[np.frombuffer(b"".join(r.ljust(4, b"\0") for r in raw), np.uint8).reshape(-1, 4)]
            for k in range(int(length.max())):
                some = length[which] > k
                wide[begin[odd[some]] + k] = table[which[some], k]
        return wide, begin


def encode_batch(lattice: Lattice, keys: np.ndarray, texts: list[str | None], seed: int = SEED) -> list[np.ndarray]:
    """Sampled piece numbers of each text; keys: an unsigned number for each row."""
    runs, per = [], []
    for t in texts:
        r = _RUNS.findall(" " + t) if t else []
        runs += r
        per.append(len(r))
    if not runs:
        return [np.zeros(0, np.int32) for _ in texts]
    per_row = np.array(per)
    last = lattice.lookup(runs)
    first = np.cumsum(per_row) - per_row
    place = (np.arange(len(runs)) - np.repeat(first, per_row)).astype(np.uint64)
    draw = _mixed(np.repeat(_mixed(keys ^ _mixed(np.array([seed], np.uint64))), per_row) + place * _M2)
    pieces, count = lattice.sample(last, draw)
    pieces, begin = lattice.spelt(pieces)
    run_end = np.concatenate(([0], np.cumsum(count)))
    row_end = begin[run_end[np.concatenate((first, [len(runs)]))]]
    return np.split(pieces, row_end[1:-1])


def decode(lattice: Lattice, ids: list[int]) -> str:
    """The text that the pieces spell, without the leading space that encoding adds."""
    if not ids:
        return ""
    return b"".join(map(lattice.tables.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def lattice_of(model: bytes, alpha: float = ALPHA, beta: float = BETA) -> Lattice:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    pieces = read_pieces(model)
    return Lattice(pieces, byte_ids, min(s for _, s in pieces.values()), alpha, beta)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, alpha: float = ALPHA, beta: float = BETA, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """For every row its id, token_ids (if with_ids), n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and
    lossless: whether decoding gives the text back.

    The row key is a hash of the id, so equal ids with equal texts get equal segmentations. Null and empty texts have no
    pieces and are lossless; a null id has a key of its own; an empty table gives no rows; other columns are dropped.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col), F.xxhash64(F.col(id_col)).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    ids_type = "token_ids array<int>, " if with_ids else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lattice = lattice_of(model.value, alpha, beta)
        texts = batch.column("_text").to_pylist()
        rows = encode_batch(lattice, batch.column("_key").to_numpy().view(np.uint64), texts, seed)
        same = [decode(lattice, r.tolist()) == (t or "") for r, t in zip(rows, texts, strict=True)]
        cols = {id_col: batch.column(id_col)}
        if with_ids:
            ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
            cols["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
        cols |= {"n_pieces": pa.array([len(r) for r in rows], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows]), "lossless": pa.array(same, pa.bool_())}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return base.mapInArrow(map_slices(run, "_text", SLICE), f"`{id_col}` {kind}, {ids_type}n_pieces long, ids_sha256 string, lossless boolean")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
