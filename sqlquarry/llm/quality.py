"""Quality classifier: a weak-label model over heuristic labellers, whose posterior trains a hashed linear scorer.

Labellers vote reject, keep or abstain: four on style, one on a lexicon mined from toxic labelled rows, one that repeats the
label where there is one. Expectation-maximisation estimates each labeller's votes given the hidden class (a table of vote
patterns with their counts over all documents is all it needs) and gives a posterior for each pattern. A logistic scorer on
hashed words, word beginnings and style marks learns the posteriors of a bounded sample and judges every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, removed, table, tidy, written

#: Bound on the labelled rows that the lexicon and the scorer are fitted on, each with its whole text.
SAMPLE_ROWS = 8000
DIMS = 1 << 18
REJECT, KEEP, ABSTAIN = 1, 0, 2
LABELLERS = ("symbols", "shouting", "fragments", "repetition", "lexicon", "label")
#: A lexicon entry is in this share of toxic sample rows at least, and its rows are toxic in this share at least.
LEXICON_SHARE, LEXICON_PRECISION = 0.03, 0.97
_WORDS = re.compile(r"[^\W\d_]+")


def style_votes(text: str) -> tuple[int, int, int, int]:
    """Votes on symbols, shouting, fragments and repetition; texts of under 3 words: all abstain."""
    words = text.split()
    n = len(words)
    if n < 3:
        return ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN

    def vote(x: float, keep: float, reject: float) -> int:
        return REJECT if x >= reject else KEEP if x <= keep else ABSTAIN

    symbols = sum(map(text.count, "#$%&*^~<>{}|\\")) / len(text)
    shouts = text.count("!!") / n
    fragments = (text.count(" | ") + text.count("\n| ")) / n
    same = sum(map(eq, words, words[1:]))
    fewer = len({*words}) / n if n >= 200 else 1.0
    repeated = max(same / n if same >= 3 else 0.0, 0.5 if fewer < 0.05 else 0.0)
    return vote(symbols, 0.01, 0.03), vote(shouts, 0.02, 0.1), vote(fragments, 0.02, 0.1), vote(repeated, 0.05, 0.12)


def tokens(text: str) -> set[str]:
    """Distinct lower-cased words, and beginnings (4 and 5 letters, marked *) of longer ones."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def lexicon_vote(words: set[str], lexicon: frozenset[str]) -> int:
    hits = len(words & lexicon)
    return REJECT if hits >= 2 else KEEP if hits == 0 else ABSTAIN


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of votes) with their counts: the posterior of `reject` for each pattern, each labeller's
    vote shares given the class (labeller, class, vote), and the share of the class `reject`."""
    n, k = patterns.shape
    share = 0.5 * (patterns == REJECT).any(axis=1) + 0.05
    post = np.clip(share, 0.02, 0.9)
    label = patterns[:, -1]
    post[label == REJECT], post[label == KEEP] = 0.98, 0.02
    theta = np.zeros((k, 2, 3))
    prior = 0.1
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip(w[1].sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4))
        for j in range(k):
            for v in range(3):
                theta[j, :, v] = w[:, patterns[:, j] == v].sum(axis=1) + 0.1
        theta /= theta.sum(axis=2, keepdims=True)
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(theta[j][:, patterns[:, j]]) for j in range(k))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved = np.abs(new - post).max() if n else 0.0
        post = new
        if moved < 1e-6:
            break
    return post, theta, prior


def hashed(words: set[str], votes: tuple[int, ...]) -> np.ndarray:
    """Feature numbers of a document: the labellers' votes first, then distinct words and beginnings by XXH64."""
    from xxhash import xxh64_intdigest

    marks = [xxh64_intdigest(f"={LABELLERS[j]}:{v}") % DIMS for j, v in enumerate(votes)]
    own = np.unique(np.fromiter((xxh64_intdigest(w) % DIMS for w in words), np.int64, len(words)))
    return np.concatenate((np.array(marks, np.int64), own))


def score_of(weights: np.ndarray, features: np.ndarray, marks: int = 5) -> float:
    """Log-odds: votes count in full, words by one over the root of their number, so that long texts add no more noise."""
    words = features[marks:]
    return float(weights[features[:marks]].sum() + weights[words].sum() / max(1.0, len(words)) ** 0.5 + weights[-1])


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = 40, seed: int = 5, marks: int = 5) -> np.ndarray:
    """Logistic regression by AdaGrad; words in few rows keep weight 0. The last weight is the bias."""
    w, g = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-2)
    if not rows:
        return w
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int32)
    begin = np.cumsum(sizes) - sizes
    word = np.ones(len(flat), bool)
    word[(begin[:, None] + np.arange(marks)).ravel()] = False
    usable = np.bincount(flat[word], minlength=DIMS) >= min(5, max(2, len(rows) // 50))
    share = np.repeat(np.maximum(1.0, sizes - marks) ** -0.5, sizes)
    share[~word] = 1.0
    share[word] *= usable[flat[word]]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 64):
            pick = order[lo : lo + 64]
            n = sizes[pick]
            own = np.repeat(np.arange(len(pick)), n)
            e = np.repeat(begin[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at, x = flat[e], share[e]
            z = np.bincount(own, w[at] * x, minlength=len(pick)) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[pick]) * weight[pick] / len(pick)
            touched, where = np.unique(at, return_inverse=True)
            step = np.bincount(where, err[own] * x) + 1e-5 * w[touched]
            g[touched] += step**2
            w[touched] -= 0.15 * step / np.sqrt(g[touched])
            b = err.sum()
            g[-1] += b * b
            w[-1] -= 0.15 * b / np.sqrt(g[-1])
    return w


@dataclass(frozen=True)
class Model:
    lexicon: frozenset[str]
    weights: np.ndarray
    accuracies: dict[str, float]


def _sign(text: str) -> int:
    """Equal for texts that are equal but for case and white space."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(" ".join(text.lower().split()).encode("utf-8", "replace")) >> 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the weak-label model on the votes of all documents and the scorer on at most sample_rows labelled ones.

    Labels are quality and toxic, 0 or 1; reject is quality 0 or toxic 1; nulls abstain; of repeated labels the worse counts.
    Without labels the label voter abstains everywhere and the scorer learns from what the other voters agree on.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    base = docs.select(F.col(id_col).cast("string").alias("_id"), text)
    marks = labels.select(F.col(id_col).cast("string").alias("_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x"))
    marks = marks.groupBy("_id").agg(F.min("q").alias("q"), F.max("x").alias("x"))

    def signs(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([_sign(t) for t in batch.column("_text").to_pylist()], pa.int64())], names=["_id", "q", "x", "sign"])

    # labelled rows in the order of a hash, then one of equal texts with equal labels: a bounded sample
    first = written(marks.where(F.col("q").isNotNull() | F.col("x").isNotNull()).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    drawn = written(base.join(F.broadcast(first), "_id"))
    one = drawn.select("_id", "q", "x", "_text").mapInArrow(map_slices(signs, "_text"), "_id string, q int, x int, sign long").groupBy("sign", "q", "x").agg(F.min("_id").alias("_id"))
    sample = drawn.join(F.broadcast(written(one.select("_id"))), "_id").dropDuplicates(["_id"])

    def toxic_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in batches:
            for t, x in zip(batch.column("_text").to_pylist(), batch.column("x").to_pylist(), strict=True):
                own = tokens(t)
                every.update(own)
                if x == 1:
                    toxic.update(own)
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(list(every)), pa.array(list(every.values()), pa.int64()), pa.array([toxic[w] for w in every], pa.int64())], names=["token", "n", "toxic"])

    total = sample.where("x = 1").count()
    mined = sample.mapInArrow(tidy(toxic_tokens), "token string, n long, toxic long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    rows = mined.where((F.col("toxic") >= F.lit(max(5, LEXICON_SHARE * total))) & (F.col("toxic") >= LEXICON_PRECISION * F.col("n"))).select("token").collect()
    lexicon = frozenset(r[0] for r in rows)  # at most 1 / LEXICON_SHARE times the words of a sample row

    def voted(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = []
        for t in batch.column("_text").to_pylist():
            votes = (*style_votes(t), lexicon_vote(tokens(t), lexicon))
            codes.append(sum(v * 3**j for j, v in enumerate(votes)))
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(codes, pa.int32())], names=["_id", "code"])

    label_vote = F.when((F.col("q") == 0) | (F.col("x") == 1), REJECT).when((F.col("q") == 1) & F.coalesce(F.col("x") == 0, F.lit(True)), KEEP).when(F.col("x") == 0, KEEP).otherwise(ABSTAIN)
    votes = base.mapInArrow(map_slices(voted, "_text"), "_id string, code int").join(marks, "_id", "left")
    counted = votes.groupBy((F.col("code") + label_vote * 3**5).alias("code")).count().collect()  # 729 patterns at most
    codes = np.array([r[0] for r in counted], np.int64)
    patterns = np.stack([codes // 3**j % 3 for j in range(6)], axis=1) if len(codes) else np.zeros((0, 6), np.int64)
    post, theta, prior = fit_votes(patterns, np.array([r[1] for r in counted], float))
    of = dict(zip(codes.tolist(), post.tolist(), strict=True))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        feats, codes = [], []
        for t, lv in zip(batch.column("_text").to_pylist(), batch.column("vote").to_pylist(), strict=True):
            own = tokens(t)
            v = (*style_votes(t), lexicon_vote(tokens(t), lexicon))
            feats.append(hashed(own, v).astype(np.int32).tolist())
            codes.append(sum(x * 3**j for j, x in enumerate((*v, lv))))
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(feats, pa.list_(pa.int32())), pa.array(codes, pa.int32())], names=["_id", "f", "code"])

    got = sample.withColumn("vote", label_vote).mapInArrow(map_slices(features, "_text"), "_id string, f array<int>, code int").toArrow().sort_by("_id")
    rows = [f.values.to_numpy() for f in got.column("f")]  # at most sample_rows
    target = np.array([of.get(c, prior) for c in got.column("code").to_pylist()])
    weights = fit_scorer(rows, target, np.abs(2 * target - 1))  # unsure rows teach little
    removed(spark, drawn)
    accuracies = {n: float(theta[j, 1, REJECT] * prior + theta[j, 0, KEEP] * (1 - prior)) for j, n in enumerate(LABELLERS)} if len(codes) else {}
    return Model(lexicon, weights, accuracies)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (log-odds of rejection, of the whole text), votes (one letter for each labeller but the label) and rejected to
    every row, in place of columns of these names. Null and empty texts abstain and have the bias as their score; repeated
    rows are judged alike; other columns stay; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "votes", "rejected")])
    names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double, votes string"

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, weights = shared.value
        scores, votes = [], []
        for t in batch.column(text_col).to_pylist():
            own = tokens(t or "")
            v = (*style_votes(t or ""), lexicon_vote(own, lexicon))
            scores.append(score_of(weights, hashed(own, v)))
            votes.append("".join("kra"[x] for x in v))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(votes)], names=[*names, "score", "votes"])

    return base.mapInArrow(map_slices(judged, text_col), schema).withColumn("rejected", F.col("score") > 0)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.round("score", 4).alias("score"), "votes", "rejected")
