"""Structural identity of statements, clusters of equal ones, and similarity of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = {"table": ("TBL",), "structure": ("TBL", "JOINTYPE", "REL", "SHAPE"), "filtered": ("TBL", "JOINTYPE", "REL", "SHAPE", "PRED"), "strict": ("TBL", "JOINTYPE", "REL", "SHAPE", "PRED", "GROUPBY")}


def of_kind(facts: Column | str, *kinds: str) -> Column:
    return F.filter(facts, lambda f: F.substring_index(f, "|", 1).isin(*kinds))


def core_id(facts: Column | str, granularity: str = "structure") -> Column:
    """16 hexadecimal digits of the SHA-256 of the sorted facts that the granularity keeps."""
    return F.substring(F.sha2(F.array_join(F.array_sort(of_kind(facts, *TIERS[granularity])), "\n"), 256), 1, 16)


def humanized(fact: Column) -> Column:
    part = lambda n: F.element_at(F.split(fact, r"\|"), n)
    return (
        F.when(fact.startswith("TBL|"), F.concat(F.lit("table "), part(2), F.lit("."), part(3)))
        .when(fact.startswith("JOINTYPE|"), F.concat(F.lit("join-type "), part(2)))
        .when(fact.startswith("REL|"), F.concat(F.lit("join "), part(3), F.lit(" "), part(2), F.lit(" "), part(4)))
        .when(fact.startswith("PRED|"), F.concat(F.lit("predicate "), part(2), F.lit(" "), part(3)))
        .when(fact.startswith("GROUPBY|"), F.concat(F.lit("group-by "), part(2)))
        .otherwise(F.concat(F.lit("shape "), part(2)))
    )


def rows(statements: DataFrame, granularity: str = "structure") -> DataFrame:
    """core_id, file, line, table_count, join_count (distinct relations), flags, facts, columns, tables, join_types, relations."""
    rel = F.transform(of_kind("facts", "REL"), lambda f: F.substring(humanized(f), 6, 1 << 20))
    return statements.where(F.size("facts") > 1).select(
        core_id("facts", granularity).alias("core_id"), "file", "line", F.size(of_kind("facts", "TBL")).alias("table_count"), F.size(of_kind("facts", "REL")).alias("join_count"),
        "has_cte", "has_subquery", "has_union", "facts", "columns", "tables", "join_types", rel.alias("relations"),
    )


def clusters(identities: DataFrame, most: int | None = 10) -> DataFrame:
    """core_id, statements, first file and line; largest first."""
    first = F.min(F.struct("file", "line"))
    out = identities.groupBy("core_id").agg(F.count("*").alias("n"), first.alias("f")).select("core_id", "n", F.col("f.file").alias("example_file"), F.col("f.line").alias("example_line"))
    out = out.orderBy(F.desc("n"), "core_id")
    return out if most is None else out.limit(most)


#: Sets of up to so many facts go whole with each row of the index, and pairs of them are compared where they meet; pairs
#: with a larger one are first found by ids.
CARRIED = 32


def pairs_by_facts(sets: DataFrame, threshold: float) -> DataFrame:
    """pairs_by_rows of sets (id, facts)."""
    return pairs_by_rows(sets.select("id", F.explode("facts").alias("fact")), threshold)


def pairs_by_rows(each: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, shared, size_a, size_b, fa, fb), each once, of sets with a Jaccard similarity of at least threshold > 0.
    each: id, fact; distinct.

    Prefix filtering: with the facts of each set ordered from rare to frequent, two similar sets share one of the first
    n - ceil(threshold * n) + 1; so a fact that nearly all sets have makes no pairs. Sizes must fit the threshold too, and
    behind the first shared fact there must be enough others.
    """
    each = each.where("id IS NOT NULL AND fact IS NOT NULL")  # in all branches, so that they share exchanges
    freq = each.groupBy("fact").agg(F.count("*").alias("df"))
    counted = each.join(freq, "fact").select("id", "df", "fact").repartition("id")  # rows are less to send than lists of each task
    ranked = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "fact"))).alias("o"))
    n = F.size("o")
    ranked = ranked.select("id", F.transform("o", lambda x: x["fact"]).alias("facts"), n.alias("n"), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int").alias("p"))
    index = ranked.select("id", "n", "facts", F.posexplode(F.slice("facts", F.lit(1), F.col("p"))).alias("i", "fact"))
    small, large = index.where(F.col("n") <= CARRIED), index.where(F.col("n") > CARRIED).drop("facts")
    na, nb, ordered = F.col("size_a"), F.col("size_b"), F.col("a") < F.col("b")
    least = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)  # facts that similar sets share
    may = (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (F.least(na - F.col("ia"), nb - F.col("ib")) >= least)
    both = F.array_intersect("fa", "fb")  # in the order of fa
    alike = (F.size(both) >= least) & (F.size(both) / (na + nb - F.size(both)) >= threshold)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs by each fact that both have in the index."""
        named = lambda df, x: df.select(F.col("id").alias(x), F.col("n").alias(f"size_{x}"), F.col("i").alias(f"i{x}"), "fact", *[F.col(c).alias(f"f{x}") for c in df.columns if c == "facts"])
        return named(left, "a").join(named(right, "b"), "fact")

    def with_facts(pairs: DataFrame, x: str) -> DataFrame:
        return pairs.join(ranked.select(F.col("id").alias(x), F.col("facts").alias(f"f{x}")), x)

    columns = ("a", "b", "size_a", "size_b", "fa", "fb")
    # one condition, the cheap parts first; of the facts that a pair shares only the first counts
    both_small = met(small, small).where(ordered & may & alike & (F.element_at(both, 1) == F.col("fact"))).select(*columns)
    mixed = with_facts(met(large, small).where(may).select("a", "b", "size_a", "size_b", "fb").distinct(), "a").where(alike)
    flip = {"a": "b", "b": "a", "size_a": "size_b", "size_b": "size_a", "fa": "fb", "fb": "fa"}
    mixed = mixed.select(*[F.when(ordered, F.col(c)).otherwise(F.col(flip[c])).alias(c) for c in columns])
    both_large = with_facts(with_facts(met(large, large).where(ordered & may).select("a", "b", "size_a", "size_b").distinct(), "a"), "b").where(alike).select(*columns)
    return both_small.unionByName(mixed).unionByName(both_large).withColumn("shared", F.size(both))


def similarity(identities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of different core ids with a Jaccard similarity of at least threshold over all facts of their first statement."""
    if threshold <= 0:
        raise ValueError("threshold is over 0: at 0 every pair would be a result")
    one = identities.groupBy("core_id").agg(F.min_by("facts", F.struct("file", "line", "facts")).alias("facts")).select(F.col("core_id").alias("id"), "facts")
    both = pairs_by_facts(one, threshold)  # all branches read the exchange of `one`: one pass over the texts
    sim = F.bround(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 3)
    diff = lambda x, y: F.array_sort(F.transform(F.array_except(x, y), humanized))
    return both.select(F.col("a").alias("core_id_a"), F.col("b").alias("core_id_b"), sim.alias("similarity"), F.col("shared").alias("shared_facts"), diff("fa", "fb").alias("only_in_a"), diff("fb", "fa").alias("only_in_b")).orderBy(F.desc("similarity"), "core_id_a", "core_id_b")
