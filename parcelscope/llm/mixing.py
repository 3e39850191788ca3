"""Mixing sources to target weights.

Every source gets a share of all words by its weight; no target exceeds ``MOST`` times the source's own words, and what lies
above is shared among the others by weight until no target is above. A source whose target is k or more times its words is taken
k times whole (complete epochs); the rest is a weighted sample without replacement: documents have exponential keys, divided by
their quality weight, and are taken in the order of the keys until the rest is reached as nearly as whole documents allow.

Keys come from a hash of the id (of the text, if the id is null), so reruns agree, and rows with an equal key are taken together.
The order is never sorted as a whole: words are summed per source and bucket of the key's range, and only the bucket in
which a source's budget ends is sorted. A null text has no words, and a null source is a source of its own, the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import join_small
from parcelscope.session import materialize

#: Weights of the sources by code point, repeating, and the most epochs (fixed values).
WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096
#: Characters that lower a document's quality weight, each by this much of its share of the text.
MARKS, LOSS, LEAST = "#*$%&|<>0123456789", 4.0, 0.1


def size(text: Column) -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From ``LEAST`` to 1: one less the share of digits and marks, weighed."""
    marked = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(LEAST), 1 - LOSS * F.coalesce(marked / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def key(doc_id: Column, text: Column, weight: Column) -> Column:
    """An exponential variable of rate ``weight`` from a hash."""
    digest = F.md5(F.coalesce(F.concat(F.lit("mix:"), doc_id.cast("string")), F.concat(F.lit("text:"), text), F.lit("")).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(draw) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(every) - before) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    # The sources that fill up come first; the level of the first one that doesn't is everyone's.
    fits = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("common", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(every))
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("common") * F.col("weight")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.col(text_col)
    return {"size": size(text), "key": key(F.col(id_col), text, quality(text)), "source": F.col(source_col)}


def _bucket(k: Column) -> Column:
    return F.floor((1 - F.exp(-k)) * BUCKETS).cast("int")


def cuts(keyed: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_bucket, cut_key): what a document's taken words depend on, of (source, size, key)."""
    summed = materialize(keyed.groupBy("source", _bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("words")), "mix-sums")
    budget = targets(summed.groupBy("source").agg(F.sum("words").alias("source_size")))
    budget = budget.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    budget = materialize(budget, "mix-budget")
    running = Window.partitionBy("source").orderBy("bucket")
    reached = summed.withColumn("until", F.sum("words").over(running)).withColumn("before", F.col("until") - F.col("words"))
    edge = reached.join(budget.select(F.col("source").alias("own"), "rest"), F.col("source").eqNullSafe(F.col("own"))) \
        .where("before <= rest AND rest < until").select("source", "bucket", "before", "rest")
    edge = materialize(edge, "mix-edge")
    inside = join_small(keyed.withColumn("bucket", _bucket(F.col("key"))), edge.withColumnRenamed("bucket", "edge"), "source") \
        .where("bucket = edge")
    tied = inside.groupBy("source", "edge", "before", "rest", "key").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("key")
    ranked = tied.withColumn("ends", F.col("before") + F.sum("size").over(order))
    last = ranked.where(F.col("ends") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max("key").alias("cut_key"))
    last = last.select(F.col("source").alias("of"), "cut_key")
    ends = edge.select(F.col("source").alias("at"), F.col("bucket").alias("cut_bucket"))
    out = budget.join(ends, F.col("source").eqNullSafe(F.col("at")), "left").join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    return materialize(out.select("source", "source_size", "target", "epochs", "cut_bucket", "cut_key"), "mix-cuts")


def taken() -> Column:
    """Words taken of a document: its epochs, and once more if its key is below the cut."""
    chosen = (F.col("bucket") < F.coalesce("cut_bucket", F.lit(0))) | \
        ((F.col("bucket") == F.col("cut_bucket")) & (F.col("key") <= F.col("cut_key")))
    return F.col("size") * (F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    keyed = materialize(docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in _keyed(docs, id_col, text_col, source_col).items())),
                        "mix-keys")
    decided = join_small(keyed.withColumn("bucket", _bucket(F.col("key"))), cuts(keyed), "source")
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", taken().cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row and column as often as it is taken; texts stay where they are."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    parts = _keyed(docs, f"row.{id_col}", f"row.{text_col}", f"row.{source_col}")
    keyed = materialize(row.select(*(parts[n].alias(n) for n in ("source", "size", "key"))), "mix-keys")
    local = row.withColumns(parts).withColumn("bucket", _bucket(F.col("key")))
    decided = join_small(local, cuts(keyed), "source")
    times = F.when(F.col("size") > 0, (taken() / F.col("size")).cast("int")).otherwise(F.lit(0))
    copies = decided.withColumn("time", F.explode(F.array_repeat(F.lit(1), times)))
    return copies.select(*(F.col("row")[c].alias(c) for c in docs.columns))


#: The mix in SQL: the whole order of the keys instead of buckets.
SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         -ln((('0x' || substr(md5(coalesce('mix:' || doc_id::VARCHAR, 'text:' || text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / greatest(0.1::DOUBLE, 1 - 4.0::DOUBLE * coalesce((length(text) - length(translate(text, '#*$%&|<>0123456789', '')))::DOUBLE
                                                / nullif(length(text), 0), 0)) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed),
common AS (SELECT min_by(level, most / weight) AS common FROM levels WHERE level * weight <= most),
budget AS (
  SELECT source, source_size, least(most::DOUBLE, common * weight) AS target FROM levels, common),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM budget),
ranked AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) AS ends
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN ends - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
