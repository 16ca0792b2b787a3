"""Token counts by a compiled finite-state transducer.

The pieces of a byte-pair model become a deterministic transducer over characters. Its state holds, for every start in the
text read so far from which a piece may still grow, the last token before that start and the count up to it; reading a
character settles the one token that ends there (tokens t and u stand side by side in a tokenisation if and only if the
two together are tokenised as t, u) and emits the change of the count. States and transitions are compiled when first
reached. A space after another character returns to the start state, as no piece has one inside, so a run from one such
reset to the next is one macro-transition with a fixed count.

A text is cut into chunks. A chunk's state map takes an entry state to the exit state and the tokens emitted on the way. It is
filled for the entry that the characters before the chunk make likely, so maps don't wait for one another, and for any other
entry when one turns up. With a reset inside, all entries have one exit, and only the count of the part before it differs.
Maps are composed pairwise in a tree (the up-sweep of a parallel prefix scan); a composed map asks its halves.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
LIMIT = 4096
#: Entries of a worker's tables of runs, of pieces and of pairs; of states; and of transitions. A full one starts anew.
MEMO, MAX_STATES, MAX_STEPS = 500_000, 200_000, 600_000
#: Characters before a chunk that its likely entry state is read from.
MARGIN = 64
SPACE = "▁"


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read by the driver; tasks get its bytes (half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Deterministic transducer over characters whose emissions add up to the number of tokens."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: scores by piece; adjacent symbols merge, highest score first, then leftmost."""
        self.score = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        self.resets = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.whole: dict[str, bool] = {}
        self.side: dict[tuple[str, str], bool] = {}
        self.start = (("", "", 0),)
        self.memo: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.number, self.states, self.next, self.steps = {self.start: 0}, [self.start], [{}], 0

    def numbered(self, state: tuple) -> int:
        """The state's number, a new one if it has none. States that are kept elsewhere are kept whole, as numbers change."""
        n = self.number.get(state)
        if n is None:
            if len(self.states) >= MAX_STATES:
                self.forget()
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return n

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by repeated merging."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, last: str, piece: str) -> bool:
        """Whether the piece is a token and may follow the token last."""
        ok = self.whole.get(piece)
        if ok is None:
            if len(self.whole) >= MEMO:
                self.whole.clear()
            ok = self.whole[piece] = len(piece) == 1 or (piece in self.score and self.merged(piece) == [piece])
        if not ok or not last:
            return ok
        pair = (last, piece)
        ok = self.side.get(pair)
        if ok is None:
            if len(self.side) >= MEMO:
                self.side.clear()
            ok = self.side[pair] = self.merged(last + piece) == [last, piece]
        return ok

    def compile(self, state: int, c: str) -> tuple[int, int]:
        live = self.states[state]
        token, count = None, 0
        for text, last, n in live:  # longest first
            piece = text + c
            if self.stands(last, piece):
                token, count = piece, n + (1 if piece in self.score else len(piece.encode()))
                break
        grown = [(text + c, last, n - count) for text, last, n in live if text + c in self.prefixes]
        steps, to = self.next[state], self.numbered((*grown, ("", token, 0)))
        steps[c] = step = (to, count)  # in no table any more if that was a new start
        self.steps += 1
        return step

    def read(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and tokens emitted."""
        total, table = 0, self.next
        for c in text:
            step = table[state].get(c)
            if step is None:
                if self.steps >= MAX_STEPS:
                    now = self.states[state]
                    self.forget()
                    state = self.numbered(now)
                step = self.compile(state, c)
                table = self.next
            state = step[0]
            total += step[1]
        return state, total

    def run(self, text: str) -> int:
        """The macro-transition of a whole run."""
        n = self.memo.get(text)
        if n is None:
            n = self.read(0, text)[1]
            if len(text) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = n
        return n

    def whole_runs(self, runs: list[str]) -> int:
        counts = [*map(self.memo.get, runs)]
        return sum(self.run(r) if n is None else n for r, n in zip(runs, counts, strict=True)) if None in counts else sum(counts)

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of the whole text, with the model's leading space."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= chunk and self.resets:
            return self.whole_runs(RUNS.findall(text))
        maps = [Chunk(self, text[i : i + chunk], text[max(0, i - MARGIN) : i]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [Pair(self, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].at(self.start)[1]


class Chunk:
    """State map of a chunk: entry state -> exit state, tokens emitted."""

    def __init__(self, t: Transducer, text: str, before: str):
        self.t, self.first, self.last = t, text[:1], text[-1:]
        runs = RUNS.findall(text) if t.resets else [text]
        self.head, self.rest, self.exit = runs[0], 0, None
        if len(runs) > 1:
            state, n = t.read(0, runs[-1])
            self.exit, self.rest = t.states[state], n + t.whole_runs(runs[1:-1])
        self.known: dict[tuple, tuple[tuple, int]] = {}
        likely = RUNS.findall(before)[-1] if before and t.resets else before
        self.at(t.states[t.read(0, likely)[0]])

    def at(self, entry: tuple) -> tuple[tuple, int]:
        found = self.known.get(entry)
        if found is None:
            t = self.t
            state, n = t.read(t.numbered(entry), self.head)
            found = self.known[entry] = (self.exit or t.states[state], n + self.rest)
        return found


class Pair:
    """The state map of two maps in a row."""

    def __init__(self, t: Transducer, a: Chunk | Pair, b: Chunk | Pair):
        self.t, self.a, self.b, self.first, self.last = t, a, b, a.first, b.last
        self.reset = t.resets and b.first == SPACE != a.last
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def at(self, entry: tuple) -> tuple[tuple, int]:
        found = self.known.get(entry)
        if found is None:
            middle, n = self.a.at(entry)
            out, more = self.b.at(self.t.start if self.reset else middle)
            found = self.known[entry] = (out, n + more)
        return found


RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def read_pieces(model: bytes) -> dict[str, tuple[int, float]]:
    """Id and score of each ordinary piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not odd(i)}


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer({p: s for p, (_, s) in read_pieces(model).items()})


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit to every row, in place of columns of these names.

    Nulls count as empty: no bytes, no tokens. Repeated rows and ties are independent; an empty table gives an empty one.
    One pass without a shuffle; memory is the model, the tables of runs and states (bounded) and one slice of texts.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_bytes", "n_tokens", "over_limit")])
    names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_tokens long"

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = transducer(model.value)
        n = [t.count(x) if x else 0 for x in batch.column(text_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    out = base.mapInArrow(map_slices(counted, text_col), schema)
    return out.select(*names, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
