"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions.

Every document gets an exponential key divided by its quality weight, drawn from a hash of its id and size, so that
reruns agree. A source's budget of words first covers whole epochs, in which each document is taken once; what is
left goes to its documents in the order of their keys until their prefix sum reaches it, and the document at that
border gives the part that is missing. Keys are dealt to buckets of about the same number of documents, by the share of
keys below each that the source's weights lead to: bucket sums give each bucket the sum before it, and only inside a
bucket are documents sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and times that a source may be repeated.
SHARE, REPEATS = 1.5, 2.0
BUCKET_DOCS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight from 0.2 to 1: highest where words have about the usual mean length."""
    mean = F.coalesce((F.length(text) - size + 1) / F.nullif(size, F.lit(0)), F.lit(1.0))
    return F.greatest(F.lit(0.2), 1.0 / (1.0 + F.abs(F.log(F.greatest(mean, F.lit(0.1)) / 5.0))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, target, docs) from rows (source, size): share of all words by weight, no source over repeats
    times its own; the excess goes to the others by weight.

    The sources that stop at their limit are those with the least limit for their weight, up to the first that the
    rest of the budget, shared among it and those after it, leaves below its limit. One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(names) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), k + 1))
    per = per.withColumn("most", F.col("source_size") * F.lit(repeats))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return per.select("source", "source_size", F.least("most", F.coalesce(free * F.col("weight"), F.col("most"))).alias("target"), "docs")


def bucketed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: int = 11, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, key, source_size, target, docs, bucket: mix()'s rows before the prefix sums."""
    text = F.col("text").cast("string")
    size = word_count(text)
    drawn = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256)
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = (quality(text, size) if weight is None else weight).cast("double")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), weight.alias("weight"), u.alias("u"))
    own = materialize(own.withColumn("key", -F.log("u") / F.col("weight")).drop("u"), "mix")
    kinds = own.groupBy(F.col("source").alias("of"), F.floor(F.log2("weight") * 8).alias("kind")).agg(F.avg("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("of").agg(F.collect_list(F.struct("w", "n")).alias("kinds"))  # a few tens for each source
    per = targets(own, weights, share, repeats)
    per = materialize(per.join(kinds, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "targets")
    buckets = F.greatest(F.ceil(F.col("docs") / BUCKET_DOCS), F.lit(1))
    below = F.aggregate("kinds", F.lit(0.0), lambda s, x: s + x["n"] * (1.0 - F.exp(-x["w"] * F.col("key")))) / F.col("docs")
    same = own.select(F.col("source").alias("of"), "doc_id", "size", "key")
    rows = same.join(per, F.col("of").eqNullSafe(F.col("source")))
    return rows.withColumn("bucket", F.least(F.floor(below * buckets), buckets - 1).cast("int")).drop("of", "kinds")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: int = 11, weight: Column | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken (words).

    taken is at most size times the epochs, whole and fractional, of its source. Null and empty texts have size 0 and
    are never taken; null sources are one source, the last; null ids and repeated rows stay, each sampled by itself
    in a fixed order; an empty table gives none; other columns are ignored; of a very long text only its size and hash
    are moved. weight, a positive column, replaces the quality weight.
    """
    rows = bucketed(docs, weights, share, repeats, seed, weight)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    more = F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as often as the mix takes each: whole epochs and, where a part is taken, the whole text once more.

    Documents that it does not take go, empty ones among them. Rows without an id are told apart by their text; rows that
    share both are repeated alike. All columns stay, whatever their names; an empty table gives none.
    """
    key, times = free_names(docs, "__key", "__times")
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    taken = mix(docs.withColumn("doc_id", own), **how).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias(key)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    out = docs.withColumn(key, own).join(taken, key)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times)


def op9_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB. The same draw, with one sort and one running sum for each source.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(sha256('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / greatest(0.2, 1.0 / (1.0 + abs(ln(greatest(coalesce((length(text) - size + 1) / nullif(size, 0), 1.0), 0.1) / 5.0)))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, most / weight) FROM l WHERE level * weight <= most) * weight, most)) AS target FROM l),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM r
"""
