"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger has a row for each scan of a blob: the rules
(kind@version) it was scanned with and the spans found. A run scans a blob once, with the rules that the ledger does not yet
have for it, adds a ledger row, and joins the spans back to every path that has the content.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, shared_dir, sized, table, written

# The base kinds, in the order that ties are sorted by.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of regex whose group has at least `least` characters.

    needs: lower-case strings of which a text that matches has one (checked first, as that is cheap); none: always tried.
    """

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    version: int = 1
    base: bool = False
    needs: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", ASSIGN, 8, 2, base=True, needs=("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True, needs=("akia",)),
    Rule("hex", r"[0-9a-f]+", 32, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs=("eyj",)),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", needs=("aiza",)),
)

LEDGER_SCHEMA = "blob string, rules array<string>, spans array<struct<start:long,kind_no:int,end:long,kind:string>>"
#: Spans are summed up in blocks of this many, so that a text with very many matches costs no square of them.
_BLOCK = 256


def _starts(steps: Column) -> Column:
    """For an array of lengths, the sum of those before each."""

    def running(part: Column, base: Column) -> Column:
        zero = F.struct(base.alias("s"), F.expr("CAST(array() AS array<bigint>)").alias("o"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["o"], F.array(a["s"])).alias("o")), lambda a: a["o"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
    bases = running(sums, F.lit(0).cast("long"))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), bases.alias("s")), lambda x: running(part(x["b"]), x["s"])))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's spans in the text: code points, end exclusive."""
    pattern = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g).cast("long"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(found, lambda m: F.struct(F.length(m).cast("long").alias("n"), (F.length(F.regexp_extract(m, rule.regex, rule.group)) if rule.group else F.length(m)).alias("g")))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), sized.alias("m")), lambda x: x["m"].isNotNull())
    starts = _starts(F.transform(pairs, lambda x: x["gap"] + x["m"]["n"]))
    rows = F.arrays_zip(pairs.alias("p"), starts.alias("s"))
    rows = F.filter(rows, lambda x: x["p"]["m"]["g"] >= rule.least)
    start = lambda x: x["s"] + x["p"]["gap"]
    return F.transform(rows, lambda x: F.struct(start(x).alias("start"), F.lit(number).alias("kind_no"), (start(x) + x["p"]["m"]["n"]).alias("end"), F.lit(rule.kind).alias("kind")))


def _may_match(text: Column, lower: Column, rule: Rule) -> Column:
    # a text with a kept match has one; the run length is checked here where the match is a run of one class
    if rule.needs:
        out = F.lit(False)
        for s in rule.needs:
            out = out | F.contains(lower, F.lit(s))
        return out
    return text.rlike(rule.regex[:-1] + f"{{{rule.least}}}") if rule.regex.endswith("]+") else text.rlike(rule.regex)


_NONE = "CAST(array() AS array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>)"


def scan(versions: DataFrame, id_cols: Sequence[str], text_col: str, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For every row of versions (a path, or a path at a version) its id columns, blob, and spans sorted by start, then rule.

    Only blobs that the ledger (a folder of Parquet files that all executors reach) does not have with a rule's version are
    scanned, with that rule only; the folder gets what was found, also where that is nothing. Without a ledger a new one
    in the shared folder is used. Null text counts as empty; null ids and repeated rows are kept, one result for each; equal
    texts share one scan, whatever their ids; an empty table gives no rows; other columns are not carried. No text is
    shuffled but one copy of each that repeats (and of each that the ledger has in part).
    """
    spark = versions.sparkSession
    ledger = ledger or shared_dir(spark)
    ids = [f"_id{k}" for k in range(len(id_cols))]
    docs = versions.select(*[F.col(c).alias(i) for c, i in zip(id_cols, ids, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("blob", F.sha2("_text", 256))
    paths = written(docs.select(*ids, "blob"))

    wanted = F.array(*[F.lit(r.id) for r in rules])
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n"), F.min(F.xxhash64(*ids)).alias("_row"))
    known = _read_ledger(spark, ledger)
    if known is not None:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
    else:
        blobs = blobs.withColumn("todo", wanted)
    # texts stay where they are: blobs of one row are scanned in place, of others one row's text is taken first
    fresh = (F.col("n") == 1) & (F.col("todo") == wanted)
    blobs = written(blobs if known is not None else blobs.where(~fresh))
    odd = blobs.where(~fresh)
    if known is not None and blobs.where(fresh).count() < odd.count():
        alone = docs.join(sized(blobs.where(fresh).select("blob")), "blob", "left_semi")
    else:
        alone = docs.join(sized(odd.select("blob")), "blob", "left_anti")
    alone = alone.select("blob", "_text", wanted.alias("todo"))
    blobs = odd
    repeated = docs.withColumn("_row", F.xxhash64(*ids)).join(sized(blobs.where(F.size("todo") > 0).select("blob", "_row")), ["blob", "_row"], "left_semi")
    repeated = repeated.groupBy("blob").agg(F.min("_text").alias("_text")).join(blobs.select("blob", "todo"), "blob")
    one = alone.unionByName(repeated.select("blob", "_text", "todo"))
    lower, text = F.col("_lower"), F.col("_text")
    parts = [
        F.when(F.array_contains("todo", r.id) & _may_match(text, lower, r), spans_of(text, r, k)).otherwise(F.expr(_NONE))
        for k, r in enumerate(rules)
    ]
    done = one.withColumn("_lower", F.lower("_text")).select("blob", F.col("todo").alias("rules"), F.array_sort(F.flatten(F.array(*parts))).alias("spans"))
    done.write.mode("append").parquet(ledger)

    found = _read_ledger(spark, ledger).where(F.size("spans") > 0)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    # a ledger row counts for the kinds whose present version it was scanned with
    valid = F.transform(F.array_intersect("rules", wanted), lambda r: F.substring_index(r, "@", 1))
    found = found.select("blob", F.transform(F.filter("spans", lambda s: F.array_contains(valid, s["kind"])), lambda s: F.struct(s["start"].alias("start"), (F.array_position(kinds, s["kind"]) - 1).cast("int").alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
    found = written(found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))
    out = _with_spans(paths, found)
    return out.select(*[F.col(i).alias(c) for c, i in zip(id_cols, ids, strict=True)], "blob", F.coalesce("spans", F.expr(_NONE)).alias("spans"))


#: Blobs with secrets, and bytes of their spans, that are broadcast at most; more are joined by a shuffle.
MAX_ROWS, MAX_BYTES = 200_000, 64 << 20


def _with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the spans of their blob, or null. A blob of many rows never draws them into one task: found is broadcast
    where it is small, else its blobs get a copy for each salt."""
    blobs, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if blobs <= MAX_ROWS and (blobs + spans) * 64 <= MAX_BYTES:
        return rows.join(F.broadcast(found), "blob", "left")
    hit = rows.join(found.select("blob"), "blob", "left_semi")
    hit = salted_join(hit, found, "blob", hit.select("blob"))
    rest = rows.join(found.select("blob"), "blob", "left_anti")
    return hit.unionByName(rest.withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))


def _read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, rules: Sequence[Rule] = RULES) -> list[Column]:
    """n_<kind> of each base kind, base_sha256, and spans as a string."""
    base = [r.kind for r in rules if r.base]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base] + [F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


def _pieces(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span replaced by the mask, overlapping ones by one. Pieces are gathered in blocks and joined once, so
    that a text with very many spans costs no square of them."""
    step = "struct<at: int, out: array<string>>"

    def within(part: Column, at: Column) -> Column:
        def cut(a, x):
            keep = F.when(x["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], keep).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")).cast(step), cut)

    flat = F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(flat, b * _BLOCK + 1, F.lit(_BLOCK))
    high = F.transform(blocks, lambda b: F.array_max(F.transform(part(b), lambda x: x["end"])))
    before = F.transform(blocks, lambda b: F.coalesce(F.array_max(F.slice(high, F.lit(1), b)), F.lit(0)))
    cuts = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("at")), lambda x: within(part(x["b"]), x["at"])["out"]))
    rest = F.substring(text, F.array_max(high) + 1, F.length(text))
    return F.concat(F.array_join(cuts, ""), rest)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: Sequence[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span that scan() finds replaced by the mask (overlapping spans by one); all rows and columns stay, also
    those named like the operator's own.

    Null texts stay null; ids don't matter, as spans are joined by content; repeated rows are each masked; an empty table
    gives no rows.
    """
    own = {c: f"_u{k}" for k, c in enumerate(docs.columns)}
    text = F.col(own[text_col])
    renamed = docs.select(*[F.col(f"`{c}`").alias(u) for c, u in own.items()], F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256).alias("blob"))
    found = scan(docs, [id_col], text_col, ledger, rules).where(F.size("spans") > 0).select("blob", "spans")
    found = written(found.groupBy("blob").agg(F.min("spans").alias("spans")))
    masked = F.when(F.col("spans").isNull(), text).otherwise(_pieces(text.cast("string"), F.col("spans"), mask))
    return _with_spans(renamed, found).select(*[(masked if c == text_col else F.col(u)).alias(c) for c, u in own.items()])


def oracle_op7(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for op7: spans from the lengths of what lies between matches and of the matches."""
    quoted = lambda r: "'" + r.regex.replace("'", "''") + "'"
    each = "\nUNION ALL ".join(
        f"SELECT doc_id, {k} AS no, '{r.kind}' AS kind, {str(r.base).lower()} AS base, "
        f"list_transform(regexp_split_to_array(t, {quoted(r)}), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, {quoted(r)}), lambda x: length(x)) AS m, "
        f"list_transform(regexp_extract_all(t, {quoted(r)}, {r.group}), lambda x: length(x)) AS q, {r.least} AS least FROM d WHERE regexp_matches(t, {quoted(r)})"
        for k, r in enumerate(rules)
    )
    counts = ", ".join(f"coalesce(sum((kind = '{r.kind}')::INT), 0)::BIGINT AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({each}),
s AS (SELECT doc_id, no, kind, base, m[i] AS n, coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(m[1:i - 1]), 0) AS a
  FROM r, unnest(range(1, len(m) + 1)) AS u(i) WHERE q[i] >= least),
o AS (SELECT doc_id, no, kind, base, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, no) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, no), '') AS spans
FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id"""


ORACLE_OP7 = oracle_op7()


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", *digests(found))
