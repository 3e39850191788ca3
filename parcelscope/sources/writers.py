"""Writers: exports, idempotent replacement of results, ledger appends and supersession."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parcelscope.operators.portfolio import EXPORT_COLUMNS, json_rows
from parcelscope.session import materialize

RESULT_BUCKETS = 256


def _flat(df: DataFrame) -> DataFrame:
    """Columns a CSV file can hold: lists and maps as JSON text."""
    cells = []
    for field in df.schema.fields:
        nested = field.dataType.typeName() in ("array", "map", "struct")
        cells.append(F.to_json(field.name).alias(field.name) if nested else F.col(field.name))
    return df.select(*cells)


def export_csv(properties: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Selected columns, newest first; the sort is a range exchange and every task writes its part."""
    wanted = list(columns or EXPORT_COLUMNS)
    unknown = [name for name in wanted if name not in properties.columns]
    if unknown:
        raise ValueError(f"unknown export columns {unknown}")
    _flat(properties.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).select(*wanted)) \
        .write.mode("overwrite").option("header", "true").csv(path)


def full_export(tables: Mapping[str, DataFrame], facts: DataFrame, folder: str) -> list[str]:
    """Every table as CSV and the ledger as JSON lines with sorted keys; returns the paths written."""
    written = []
    for name, df in tables.items():
        _flat(df).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")
        written.append(f"{folder}/{name}.csv")
    json_rows(facts, "value").write.mode("overwrite").text(f"{folder}/facts.jsonl")
    return [*written, f"{folder}/facts.jsonl"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("property_id"), F.lit(buckets)).cast("int")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, none where nothing was written yet; a table that can't be read is an error, not an absent one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def replace_results(results: DataFrame, path: str, buckets: int = RESULT_BUCKETS) -> None:
    """Replace the rows of the properties in ``results`` and keep all others; running it twice changes nothing.

    The table is partitioned by a hash bucket of the property. Only buckets with recomputed properties are rewritten, through
    dynamic partition overwrite, from rows that were written to the shared folder before the swap.
    """
    spark = results.sparkSession
    fresh = results.withColumn("bucket", _bucket(buckets))
    existing = _existing(spark, path)
    if existing is not None:
        touched = fresh.select("bucket").distinct()
        kept = existing.join(F.broadcast(touched), "bucket", "left_semi").join(
            results.select("property_id").distinct(), "property_id", "left_anti")
        fresh = fresh.unionByName(kept.select(*fresh.columns))
    rows = materialize(fresh, "replace")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def mark_recomputed(properties: DataFrame, underwriting: DataFrame, at: datetime) -> DataFrame:
    """Properties with the status and time of their latest recompute."""
    status = underwriting.where("scenario = 'expected'").select("property_id", F.col("status").alias("new_status"))
    rows = properties.join(status, "property_id", "left")
    return rows.withColumn("underwriting_status", F.coalesce("new_status", "underwriting_status")) \
        .withColumn("last_recomputed_at", F.when(F.col("new_status").isNotNull(), F.lit(at).cast("timestamp"))
                    .otherwise(F.col("last_recomputed_at"))).drop("new_status")


def append_facts(facts: DataFrame, path: str) -> None:
    """Add facts, active and inactive, whose ids the ledger does not hold yet."""
    existing = _existing(facts.sparkSession, path)
    if existing is not None:
        facts = facts.join(existing.select("fact_id"), "fact_id", "left_anti")
    materialize(facts.dropDuplicates(["fact_id"]), "append").write.mode("append").parquet(path)


def supersede(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ledger after reports were extracted again: their active facts become inactive and point to the new fact of the same
    report, entity and field, if there is one; the new facts are added."""
    again = fresh.select("report_id").distinct().withColumn("is_again", F.lit(True))
    new_id = fresh.groupBy("report_id", "entity_local_id", "field_path").agg(F.max("fact_id").alias("new_fact_id"))
    old = ledger.join(again, "report_id", "left").join(new_id, ["report_id", "entity_local_id", "field_path"], "left")
    closing = F.expr("is_active AND is_again IS NOT NULL")
    old = old.withColumn("superseded_by", F.when(closing, F.col("new_fact_id")).otherwise(F.col("superseded_by"))) \
             .withColumn("is_active", F.expr("is_active AND is_again IS NULL")).drop("is_again", "new_fact_id")
    return old.unionByName(fresh.withColumn("superseded_by", F.lit(None).cast("string")), allowMissingColumns=True).select(*ledger.columns)


def change_rows(events: DataFrame, detected_at: datetime, source_report_id: int | None = None) -> DataFrame:
    """Change events as table rows with the values as JSON."""
    return events.select(
        F.sha2(F.concat_ws("|", F.col("property_id").cast("string"), "change_type", "field_path", F.coalesce("old_value", F.lit("")),
                           F.coalesce("new_value", F.lit("")), F.lit(str(detected_at))), 256).alias("event_id"),
        "property_id", "change_type", "field_path", F.to_json(F.struct(F.col("old_value").alias("value"))).alias("old_json"),
        F.to_json(F.struct(F.col("new_value").alias("value"))).alias("new_json"),
        F.lit(source_report_id).cast("bigint").alias("source_report_id"), F.lit(detected_at).cast("timestamp").alias("detected_at"))


def append_snapshot(rows: DataFrame, path: str) -> None:
    """Append a ranking snapshot, partitioned by scope type and time."""
    rows.write.mode("append").partitionBy("scope_type", "ranked_at").parquet(path)
