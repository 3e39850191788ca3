"""Ranking of a scope with the previous rank carried forward, without a single-task sort.

``global_positions`` range-partitions the rows on the full sort order, so equal scores are split by property as
well, numbers every partition on its own and adds the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.functions.lookups import UNRANKABLE_GATES
from parcelscope.session import materialize

RANKINGS = ("scope_type string, scope_id string, property_id bigint, rank bigint, prev_rank bigint, "
            "score decimal(9,4), ranked_at timestamp")


def global_positions(df: DataFrame, scope: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row within its scope in a total order.

    The laid-out rows are written to the shared folder first: partition numbers and offsets then come from the
    same files, also when an executor is lost in between.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(parts, *scope, *order).sortWithinPartitions(*scope, *order)
            .withColumn("part_", F.spark_partition_id())
            .withColumn("row_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    laid = materialize(laid, "positions")
    # One row per scope and partition it touches: never more than partitions plus scopes.
    sizes = laid.groupBy(*scope, "part_").agg(F.min("row_").alias("first_"), F.count("*").alias("size_"))
    before = Window.partitionBy(*scope).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*scope, "part_", "first_",
                           F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("before_"))
    same = F.col("l.part_") == F.col("o.part_")
    for key in scope:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = laid.alias("l").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"l.{column}") for column in df.columns],
                         (F.col("l.row_") - F.col("o.first_") + F.col("o.before_") + 1).alias(name))


def running_totals(df: DataFrame, scope: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Running sum of a value within its scope in a total order, laid out like ``global_positions``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(parts, *scope, *order).sortWithinPartitions(*scope, *order)
            .withColumn("part_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id()))
    laid = materialize(laid, "totals")
    # Sums keep the scale of the value; without the cast a decimal sum of sums would lose places.
    kind = df.schema[value].dataType
    wide = f"decimal(30,{kind.scale})" if isinstance(kind, T.DecimalType) else kind.simpleString()
    sizes = laid.groupBy(*scope, "part_").agg(F.sum(value).cast(wide).alias("size_"))
    before = Window.partitionBy(*scope).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*scope, "part_", F.sum("size_").over(before).cast(wide).alias("before_"))
    inside = Window.partitionBy(*scope, "part_").orderBy("row_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = laid.withColumn("inside_", F.sum(value).over(inside).cast(wide))
    same = F.col("l.part_") == F.col("o.part_")
    for key in scope:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = rows.alias("l").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"l.{column}") for column in df.columns],
                         (F.col("l.inside_") + F.coalesce(F.col("o.before_"), F.lit(0).cast(wide))).alias(name))


def rankable(scores: DataFrame) -> DataFrame:
    """Scores none of whose gates keeps them out of a ranking."""
    blocked = F.array(*[F.lit(gate) for gate in UNRANKABLE_GATES])
    gates = F.coalesce(F.col("gates_applied"), F.array().cast("array<string>"))
    return scores.where(~F.arrays_overlap(gates, blocked))


def latest_scores(scores: DataFrame, tie: str = "score_id") -> DataFrame:
    """The newest score per property, undated ones last; a partial aggregate picks the row."""
    newest = F.struct(F.col("computed_at").isNotNull(), F.col("computed_at"), F.col(tie))
    rest = [column for column in scores.columns if column != "property_id"]
    return (scores.groupBy("property_id").agg(F.max_by(F.struct(*rest), newest).alias("s"))
            .select("property_id", "s.*"))


def latest_snapshot(rankings: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of every scope; the scope id may be null."""
    newest = rankings.groupBy("scope_type", "scope_id").agg(F.max("ranked_at").alias("newest_"))
    r, n = rankings.alias("r"), newest.alias("n")
    same = ((F.col("r.scope_type") == F.col("n.scope_type")) & F.col("r.scope_id").eqNullSafe(F.col("n.scope_id"))
            & (F.col("r.ranked_at") == F.col("n.newest_")))
    return r.join(n, same, "left_semi")


def rank_scope(scores: DataFrame, rankings: DataFrame, scope_type: str, scope_id: str | None, ranked_at: datetime,
               members: DataFrame | None = None, latest_only: bool = False) -> DataFrame:
    """A new ranking snapshot of one scope.

    Gated scores are left out before the newest one is picked, so an older open score may rank; with
    ``latest_only`` the newest score decides alone. ``members`` limits the scope to some properties.
    """
    picked = rankable(latest_scores(scores)) if latest_only else latest_scores(rankable(scores))
    picked = picked.select("property_id", "overall")
    if members is not None:
        picked = picked.join(members.select("property_id").distinct(), "property_id", "left_semi")
    ranked = global_positions(picked, [], [F.col("overall").desc(), F.col("property_id").asc()])
    wanted = F.lit(scope_id).cast("string")
    previous = (latest_snapshot(rankings.where((F.col("scope_type") == scope_type)
                                               & F.col("scope_id").eqNullSafe(wanted)))
                .select("property_id", F.col("rank").alias("prev_rank")))
    return ranked.join(previous, "property_id", "left").select(
        F.lit(scope_type).alias("scope_type"), wanted.alias("scope_id"), "property_id",
        F.col("rank").cast("bigint").alias("rank"), F.col("prev_rank").cast("bigint").alias("prev_rank"),
        F.col("overall").cast("decimal(9,4)").alias("score"), F.lit(ranked_at).cast("timestamp").alias("ranked_at"))


def rank_scopes(scores: DataFrame, ranked_at: datetime, scope: str) -> DataFrame:
    """One ranking per value of a scope column, all scopes in one job."""
    picked = rankable(scores).groupBy(scope, "property_id").agg(
        F.max_by("overall", F.struct(F.col("computed_at").isNotNull(), F.col("computed_at"), F.col("score_id")))
         .alias("overall"))
    ranked = global_positions(picked, [scope], [F.col("overall").desc(), F.col("property_id").asc()])
    return ranked.select(F.lit(scope).alias("scope_type"), F.col(scope).cast("string").alias("scope_id"), "property_id",
                         "rank", F.col("overall").alias("score"), F.lit(ranked_at).cast("timestamp").alias("ranked_at"))


def current_ranking(rankings: DataFrame, scope_type: str) -> DataFrame:
    """The newest snapshot of a scope type in rank order; the sort is a range exchange, not one task."""
    rows = rankings.where(F.col("scope_type") == scope_type)
    newest = rows.agg(F.max("ranked_at").alias("newest_"))
    return (rows.join(F.broadcast(newest), F.col("ranked_at") == F.col("newest_"), "left_semi")
            .orderBy("rank", "property_id"))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranks of two score tables side by side; a positive delta moved up."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        order = [F.col("overall").desc(), F.col("property_id").cast("string").asc()]
        return global_positions(df.select("property_id", "overall"), [], order, name).select("property_id", name)

    both = ranked(before, "prev_rank").join(ranked(after, "new_rank"), "property_id", "full")
    return both.withColumn("delta", F.col("prev_rank") - F.col("new_rank"))
