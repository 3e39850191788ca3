"""Changes between two resolved snapshots of the portfolio, as one event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.operators.ranking import global_positions
from parcelscope.schemas import Portfolio
from parcelscope.session import materialize

VALUE_SHIFT = "0.10"
#: Entries of a key, of both snapshots, up to which they are paired as lists.
MANY = 4096
CANCELLED, COMPLETED = "('rescinded', 'cancelled')", "('sold', 'completed')"


def _event(df: DataFrame, kind: str, path: str, old: str, new: str) -> DataFrame:
    return df.selectExpr("property_id", f"{kind} AS change_type", f"{path} AS field_path",
                         f"CAST({old} AS STRING) AS old_value", f"CAST({new} AS STRING) AS new_value")


def paired(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Entries of two snapshots: the k-th of a key before meets the k-th after, the rest stays alone.

    A key's entries of both sides meet in one exchange, as two short lists in the order of ``seq``. Keys with more than ``MANY``
    entries are found by counting first; theirs are numbered by distributed positions, so none is held or sorted in one task.
    """
    scope = ["property_id", *keys]
    entry = F.struct("seq", *values).alias("entry")
    both = before.select(*scope, F.lit(True).alias("was"), entry).unionByName(after.select(*scope, F.lit(False).alias("was"), entry))
    many = materialize(both.groupBy(*scope).agg(F.count("*").alias("n")).where(F.col("n") > MANY)
                       .select(*[F.col(name).alias(f"of_{name}") for name in scope]), "many-entries")
    if not many.limit(1).collect():
        return _paired_in_lists(both, scope, values)
    same = F.lit(True)
    for name in scope:
        same = same & F.col(name).eqNullSafe(F.col(f"of_{name}"))
    few = _paired_in_lists(both.join(many, same, "left_anti"), scope, values)
    return few.unionByName(_paired_by_position(before.join(many, same, "left_semi"), after.join(many, same, "left_semi"), scope, values))


def _paired_in_lists(both: DataFrame, scope: list[str], values: list[str]) -> DataFrame:
    def side(of: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.expr(of), F.col("entry"))))

    lists = both.groupBy(*scope).agg(side("was").alias("b"), side("NOT was").alias("a"))
    pairs = lists.select(*scope, F.explode(F.arrays_zip("b", "a")).alias("pair"))
    return pairs.select(*scope, F.col("pair.b").isNotNull().alias("was"), F.col("pair.a").isNotNull().alias("is"),
                        *[F.col(f"pair.{name}.{value}").alias(f"{name}_{value}") for name in ("b", "a") for value in values])


def _paired_by_position(before: DataFrame, after: DataFrame, scope: list[str], values: list[str]) -> DataFrame:
    def numbered(df: DataFrame, side: str) -> DataFrame:
        rows = global_positions(df.select(*scope, "seq", *values), scope, [F.col("seq").asc(), *[F.col(v).asc() for v in values]], "k")
        return rows.select(*[F.col(name).alias(f"{side}_{name}") for name in (*scope, "k", *values)])

    b, a = numbered(before, "b"), numbered(after, "a")
    same = F.col("b_k") == F.col("a_k")
    for name in scope:
        same = same & F.col(f"b_{name}").eqNullSafe(F.col(f"a_{name}"))
    both = b.join(a, same, "full")
    return both.select(*[F.when(F.col("b_k").isNotNull(), F.col(f"b_{name}")).otherwise(F.col(f"a_{name}")).alias(name)
                         for name in scope],
                       F.col("b_k").isNotNull().alias("was"), F.col("a_k").isNotNull().alias("is"),
                       *[F.col(f"{side}_{name}") for side in ("b", "a") for name in values])


def foreclosure_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    columns = ("stage", "is_active", "rescission_count", "current_sale_date")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("property_id", F.lit(True).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    rows = side(before.foreclosure, "b").join(side(after.foreclosure, "a"), "property_id", "full")
    was, now = "coalesce(b_is_active, false)", "coalesce(a_is_active, false)"
    kind = f"""CASE
        WHEN NOT {was} AND {now} THEN 'new_foreclosure_notice'
        WHEN b IS NULL OR a IS NULL THEN CASE WHEN {was} AND NOT {now} THEN
            CASE WHEN a_stage IN {COMPLETED} THEN 'sale_completed' ELSE 'sale_cancelled' END END
        WHEN a_rescission_count > b_rescission_count OR (a_stage IN {CANCELLED} AND NOT b_stage IN {CANCELLED})
            THEN 'sale_cancelled'
        WHEN a_stage IN {COMPLETED} AND NOT b_stage IN {COMPLETED} THEN 'sale_completed'
        WHEN NOT b_current_sale_date <=> a_current_sale_date THEN 'sale_date_moved' END"""
    rows = rows.withColumn("kind", F.expr(kind)).where("kind IS NOT NULL")
    moved = "kind = 'sale_date_moved'"
    return _event(rows, "kind",
                  f"CASE WHEN {moved} THEN 'foreclosure.current_sale_date' ELSE 'foreclosure.stage' END",
                  f"CASE WHEN {moved} THEN CAST(b_current_sale_date AS STRING) ELSE b_stage END",
                  f"CASE WHEN {moved} THEN CAST(a_current_sale_date AS STRING) ELSE a_stage END")


def lien_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    rows = paired(before.liens, after.liens, ["lien_type", "recording_date"], ["amount", "status"])
    released = "was AND is AND a_status = 'released' AND b_status <> 'released'"
    rows = rows.withColumn("kind", F.expr(f"""CASE WHEN NOT was THEN 'new_lien' WHEN NOT is OR ({released}) THEN 'lien_released'
        WHEN NOT b_amount <=> a_amount THEN 'lien_amount_corrected' END""")).where("kind IS NOT NULL")
    part = f"CASE WHEN NOT (was AND is) THEN '' WHEN {released} THEN '.status' ELSE '.amount' END"
    return _event(rows, "kind", f"concat('liens[', lien_type, ']', {part})",
                  f"CASE WHEN {released} THEN b_status ELSE CAST(b_amount AS STRING) END",
                  f"CASE WHEN {released} THEN a_status ELSE CAST(a_amount AS STRING) END")


def listing_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    rows = paired(before.listings, after.listings, ["list_date", "status"], ["price"])
    rows = rows.withColumn("kind", F.expr("CASE WHEN NOT was THEN 'new_listing' WHEN is AND a_price < b_price THEN 'price_cut' END")) \
        .where("kind IS NOT NULL")
    return _event(rows, "kind", "concat('listings[', CAST(list_date AS STRING), ']', CASE WHEN was THEN '.price' ELSE '' END)",
                  "b_price", "a_price")


def ownership_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    """Properties whose owner names differ; the names lists are built only for those."""
    b = before.owners.distinct().withColumn("was", F.lit(1))
    a = after.owners.distinct().withColumn("is", F.lit(1))
    rows = b.join(a, ["property_id", "owner_name"], "full")
    changed = rows.groupBy("property_id").agg(F.count_if(F.expr("was IS NULL OR is IS NULL")).alias("n")).where("n > 0")
    names = rows.join(changed.select("property_id"), "property_id", "left_semi").groupBy("property_id").agg(
        F.expr("array_join(array_sort(collect_set(CASE WHEN was = 1 THEN owner_name END)), '; ') AS old"),
        F.expr("array_join(array_sort(collect_set(CASE WHEN is = 1 THEN owner_name END)), '; ') AS new"))
    return _event(names, "'ownership_transfer'", "'ownership.owner_names'", "old", "new")


def bankruptcy_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    """Filings that were not there: how many more a chapter and day has now, counted before they are joined."""
    keys = ["property_id", "chapter", "filing_date"]

    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy(*keys).agg((F.count("*") * sign).alias("n"))

    more = counted(after.bankruptcies, 1).unionByName(counted(before.bankruptcies, -1)) \
        .groupBy(*keys).agg(F.sum("n").alias("extra")).where("extra > 0")
    rows = more.withColumn("copy", F.explode(F.expr("sequence(1, CAST(extra AS INT))")))
    return _event(rows, "'new_bankruptcy'", "concat('bankruptcies[', chapter, ']')", "NULL", "filing_date")


def representative_values(p: Portfolio) -> DataFrame:
    """Value weighted by hint and confidence; an absent or zero hint counts as one."""
    weight = "CAST(coalesce(nullif(weight_hint, 0), 1) * coalesce(confidence, 0) AS DECIMAL(14,8))"
    return (p.valuations.where("value IS NOT NULL").selectExpr("property_id", "value", f"{weight} AS w")
            .groupBy("property_id").agg(F.expr("CAST(sum(value * w) AS DECIMAL(30,8)) AS wv"),
                                        F.expr("CAST(sum(w) AS DECIMAL(18,8)) AS w"))
            .where("w <> 0").selectExpr("property_id", "CAST(wv / w AS DECIMAL(20,6)) AS value"))


def value_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    old = representative_values(before).withColumnRenamed("value", "old")
    new = representative_values(after).withColumnRenamed("value", "new")
    rows = old.join(new, "property_id").where(f"old <> 0 AND abs(new - old) > {VALUE_SHIFT} * abs(old)")
    return _event(rows, "'value_shift'", "'valuation.value'", "old", "new")


def detect_changes(before: Portfolio, after: Portfolio) -> DataFrame:
    """Every reportable change between two snapshots."""
    out = foreclosure_changes(before, after)
    for part in (lien_changes, listing_changes, ownership_changes, bankruptcy_changes, value_changes):
        out = out.unionByName(part(before, after))
    return out


def diff_records(before: DataFrame, after: DataFrame) -> DataFrame:
    """Flat fallback: fields (property_id, field, value) that differ between two snapshots."""
    b = before.select("property_id", "field", F.col("value").alias("old_value"), F.lit(True).alias("was"))
    a = after.select("property_id", "field", F.col("value").alias("new_value"))
    rows = b.join(a, ["property_id", "field"], "full").where("NOT old_value <=> new_value")
    return rows.selectExpr("property_id", """CASE
        WHEN startswith(field, 'liens') THEN CASE WHEN old_value IS NULL THEN 'new_lien' ELSE 'lien_amount_corrected' END
        WHEN startswith(field, 'foreclosure') THEN
            CASE WHEN old_value IS NULL THEN 'new_foreclosure_notice' ELSE 'sale_date_moved' END
        ELSE 'field_changed' END AS change_type""", "field AS field_path", "old_value", "new_value")
