"""URL filters: fixed host and path rules, and association rules that FP-growth mines from labelled URLs.

A mined rule has to beat the base rate: its support and confidence have bounds, and so has the least confidence that its
number of rows leaves plausible (the lower end of a Wilson interval), which has to be over the verdict's share of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, written

#: (host, path, verdict); the longest that fits wins.
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The share of labelled rows that a rule's tokens and verdict have at least bounds the number of item sets; a rule's verdict
#: is the likelier one on its rows, by Z standard errors more than the verdict's share of all rows.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS, Z = 0.01, 0.5, 5, 4.0
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *_AZ), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = FIXED_RULES) -> tuple[Column, Column]:
    """The fixed rule that fits, as host + path, and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


_NUMBER = re.compile(r"\d+")


def url_tokens(url: str | None) -> list[str]:
    """Sorted distinct tokens of a URL: scheme, host labels, path words, extension, query keys; numbers become 0."""
    if not url or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    host, path, query = m[1].lower(), m[2], m[3] or ""
    out = {f"scheme={scheme.lower()}"} | {f"host={x}" for x in host.split(".") if x}
    for x in path.split("/"):
        if x:
            stem, dot, ext = x.rpartition(".")
            out.add("path=" + _NUMBER.sub("0", (stem if dot else x).lower()))
            if dot:
                out.add(f"ext={ext.lower()}")
    out |= {"key=" + x.split("=")[0].lower() for x in query.split("&") if x}
    return sorted(out)


@dataclass(frozen=True)
class Mined:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float


def pruned(rules: Sequence[Mined]) -> list[Mined]:
    """Without rules that a rule on fewer of their tokens covers with the same verdict and at least their confidence."""
    best = {(r.tokens, r.verdict): r.confidence for r in rules}
    out = []
    for r in sorted(rules, key=lambda r: (len(r.tokens), sorted(r.tokens))):
        fewer = (frozenset(c) for n in range(1, len(r.tokens)) for c in combinations(sorted(r.tokens), n))
        if not any(best.get((s, r.verdict), -1.0) >= r.confidence for s in fewer):
            out.append(r)
    return out


def _tokenised(df: DataFrame, url_col: str) -> DataFrame:
    """Adds _tokens to df."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _tokens array<string>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([url_tokens(u) for u in batch.column(url_col).to_pylist()], pa.list_(pa.string()))], names=[*names, "_tokens"])

    return df.mapInArrow(map_slices(run, url_col), schema)


def least_share(hits: float, rows: float, z: float = Z) -> float:
    """Lower end of the Wilson interval of hits among rows."""
    p = hits / rows
    return (p + z * z / (2 * rows) - z * ((p * (1 - p) + z * z / (4 * rows)) / rows) ** 0.5) / (1 + z * z / rows)


def mine(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> list[Mined]:
    """Rules tokens -> verdict from rows with a verdict of block or allow, by FP-growth over whole rows of tokens and verdict.

    Tokens below the support, and those that every row has, can't be in a useful rule. Tokens that the very same rows have
    (a host's labels) count as one, the first by name, since a rule with more of them says nothing new. Null URLs have no
    tokens; no labelled rows give no rules; repeated rows count each.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = _tokenised(labelled.where(F.col(verdict_col).isin("block", "allow")).select(F.col(url_col).cast("string").alias("url"), F.col(verdict_col).alias("v")), "url")
    rows = written(rows.select("v", "_tokens", F.monotonically_increasing_id().alias("row")))
    shares = {r["v"]: r["count"] for r in rows.groupBy("v").count().collect()}
    total = sum(shares.values())
    if not total:
        return []
    least = max(MIN_ROWS, min_support * total)
    sets = [F.sum(F.xxhash64("row", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))) for k in (1, 2)]
    common = rows.select("row", F.explode("_tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.array(*sets).alias("s"))
    common = common.where((F.col("n") >= least) & (F.col("n") < total)).groupBy("n", "s").agg(F.min("t").alias("t"))
    known = sorted(r["t"] for r in common.select("t").collect())  # at most the tokens of 1 / min_support rows
    if not known:
        return []
    items = rows.select(F.concat(F.array_intersect(F.array(*[F.lit(t) for t in known]), "_tokens"), F.array(F.concat(F.lit("verdict="), "v"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.size("consequent") == 1).where(F.col("consequent")[0].startswith("verdict="))
    out = []
    for r in found.toLocalIterator():
        verdict, hits = r["consequent"][0].removeprefix("verdict="), r["support"] * total
        if least_share(hits, hits / r["confidence"], z) > shares[verdict] / total:
            out.append(Mined(frozenset(r["antecedent"]), verdict, r["confidence"], r["support"]))
    return pruned(out)


class InvertedIndex:
    """Rules by token: a rule fits when all its tokens were met."""

    def __init__(self, rules: Sequence[Mined], default: str = "allow"):
        self.rules, self.default = list(rules), default
        self.by_token: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for t in r.tokens:
                self.by_token.setdefault(t, []).append(k)

    def verdict(self, tokens: Sequence[str]) -> tuple[str, int]:
        """Of the rules that fit the one with most confidence, then support, then block; and how many fit."""
        met: dict[int, int] = {}
        for t in tokens:
            for k in self.by_token.get(t, ()):
                met[k] = met.get(k, 0) + 1
        fit = [self.rules[k] for k, n in met.items() if n == len(self.rules[k].tokens)]
        if not fit:
            return self.default, 0
        top = max(fit, key=lambda r: (r.confidence, r.support, r.verdict == "block", sorted(r.tokens)))
        return top.verdict, len(fit)


def judge(pages: DataFrame, rules: Sequence[Mined], id_col: str = "page_id", url_col: str = "url", fixed: Sequence[tuple[str, str, str]] = FIXED_RULES) -> DataFrame:
    """For every row its id, host, path, rule (the fixed rule that fits, or null), verdict, and n_mined (mined rules that fit).

    A null URL, or one without ://, has an empty host and path, no rule, and the default verdict (allow). Repeated rows are
    judged alike, an empty table gives no rows, other columns are dropped. No shuffle.
    """
    index = pages.sparkSession.sparkContext.broadcast(InvertedIndex(rules))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        urls = batch.column("_url").to_pylist()
        found = [index.value.verdict(url_tokens(u)) for u in urls]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([v for v, _ in found]), pa.array([n for _, n in found], pa.int32())], names=["_id", "_url", "_mined", "n_mined"])

    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    out = base.mapInArrow(map_slices(run, "_url"), f"_id {kind}, _url string, _mined string, n_mined int")
    host, path = host_and_path(F.col("_url"))
    out = out.withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_mined")).alias("verdict"), "n_mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with the verdict that the labels of their document give: its number is the last in the URL's path. Block: quality 0 or toxic 1."""
    number = F.regexp_extract("url", r"://[^?#]*/(\d+)(?:\.\w+)?/?(?:[?#]|$)", 1)
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    known = pages.select("url", number.alias("_n")).select("url", F.expr("try_cast(_n AS bigint)").alias("doc_id")).join(marks, "doc_id")
    return known.select("url", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = mine(labelled_pages(pages, table(spark, sf_dir, "labels")))
    return judge(pages, rules)
