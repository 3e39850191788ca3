"""Streams run to the end of the driver tables, and sources and sinks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from parcelscope.operators import changes
from parcelscope.plans.catalog import plain, query
from parcelscope.plans.catalog.watch import OWNER_EVENTS, _snapshots
from parcelscope.plans.driver_tables import Tables
from parcelscope.session import checkpoint_dir
from parcelscope.sources import readers, writers
from parcelscope.streaming import jobs


def _folder(t: Tables, label: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def _stream(t: Tables, table: str):
    """A driver table as a stream of its files: one file, or a folder of any number of them. A path without a pattern must be a folder."""
    return t.spark.readStream.schema(t.source(table).schema).parquet(f"{t.folder}/{table}.parque[t]")


@query("STM-1_file_intake", "SRC-3")
def file_intake(t):
    out = _folder(t, "intake")
    jobs.take_in(jobs.inbox(t.spark, t.folder, "*.parquet"), out, f"{out}/checkpoint", magic="PAR1")
    accepted = t.spark.read.parquet(f"{out}/accepted").select("sha256", "length", F.lit(True).alias("is_accepted"))
    failed = t.spark.read.parquet(f"{out}/failed").select("sha256", "length", F.lit(False).alias("is_accepted"))
    return plain(accepted.unionByName(failed))


@query("STM-2_first_of_each_content", "JOI-11", sql="SELECT count(DISTINCT sha256(text)) AS reports FROM documents")
def first_of_each_content(t):
    out = _folder(t, "contents")
    reports = _stream(t, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
                                             F.lit(datetime(2002, 1, 1)).alias("seen_at"))
    jobs.run_to_end(jobs.first_of_each_content(reports, "seen_at", "1 day").writeStream.format("parquet").option("path", f"{out}/rows"),
                    f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/rows").agg(F.count("*").alias("reports")))


@query("STM-3_fan_in", sql="""
    SELECT l_partkey AS property_id, count(*) AS expected, count(*) FILTER (WHERE l_linestatus = 'O' OR l_partkey % 3 = 0) AS finished
    FROM lineitem GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE l_linestatus = 'O' OR l_partkey % 3 = 0)""")
def fan_in(t):
    out = _folder(t, "fan-in")
    units = _stream(t, "lineitem").selectExpr("l_partkey AS property_id", "1 AS expected",
                                              "CASE WHEN l_linestatus = 'O' OR l_partkey % 3 = 0 THEN 1 ELSE 0 END AS finished")
    jobs.fan_in(units, lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}"), f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/rows").drop("epoch"))


@query("STM-4_budget_stream", sql="""
    SELECT batch_id, unit_id FROM (SELECT source AS batch_id, doc_id AS unit_id,
        sum(CAST(n_chars AS DECIMAL(14,6)) * 0.0000025) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)
    WHERE running <= 0.02""")
def budget_stream(t):
    out = _folder(t, "budget")
    units = _stream(t, "documents").selectExpr("source AS batch_id", "doc_id AS unit_id", "doc_id AS arrival",
                                               "CAST(CAST(n_chars AS DECIMAL(14,6)) * 0.0000025 AS DECIMAL(20,7)) AS cost_usd")
    limits = t.source("documents").select(F.col("source").alias("batch_id")).distinct().withColumn(
        "budget_limit_usd", F.lit("0.02").cast("decimal(14,2)"))
    jobs.spend_budget(units, limits, out, f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/accepted").select("batch_id", "unit_id"))


@query("STM-5_ranking_stream", sql="SELECT property_id, CAST(rank AS BIGINT) AS rank FROM o_rank")
def ranking_stream(t):
    out = _folder(t, "ranking")
    scores = _stream(t, "orders").selectExpr(
        "o_orderkey AS score_id", "o_custkey AS property_id", "CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.0002 AS DECIMAL(9,4)) AS overall",
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS computed_at",
        "array_compact(array(CASE o_orderkey % 9 WHEN 0 THEN 'insufficient_data' WHEN 1 THEN 'dcs_below_40' WHEN 2 THEN 'open_gating_flag' END)) AS gates_applied")
    jobs.rank_after_each_batch(scores, out, f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/rankings").where("rank IS NOT NULL").select("property_id", "rank"))


@query("STM-6_change_stream", "CHG-7")
def change_stream(t):
    out = _folder(t, "changes")
    before, after = _snapshots(t)
    requests = _stream(t, "events").selectExpr("user_id AS property_id")
    jobs.changes_after_each_batch(requests, lambda epoch: before, lambda epoch, touched: after, out, f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/changes").drop("epoch"))


@query("STM-7_latest_requests", sql="""
    SELECT user_id AS property_id, arg_max(event_type, row(ts, event_type)) AS reason FROM events GROUP BY 1""")
def latest_requests(t):
    out = _folder(t, "requests")
    requests = _stream(t, "events").selectExpr("user_id AS property_id", "ts AS requested_at", "event_type AS reason")
    jobs.run_to_end(requests.writeStream.foreachBatch(
        lambda rows, epoch: jobs.latest_requests(rows).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")), f"{out}/checkpoint")
    return plain(t.spark.read.parquet(f"{out}/rows").select("property_id", "reason"))


# --- sources and sinks ------------------------------------------------------------

@query("SRC-4_pasted_reports", "STR-3", sql="""
    SELECT item_id AS report_id, sha256(text) AS sha256, 'pasted' AS vendor, CAST(1 AS BIGINT) AS page_count FROM benchmark""")
def pasted_reports(t):
    texts = t.source("benchmark").select(F.col("item_id").alias("report_id"), F.lit("b").alias("batch_id"), "text")
    return plain(readers.pasted_reports(texts).select("report_id", "sha256", "vendor", "page_count"))


@query("JOI-11_new_reports", "STM-2", sql="""
    SELECT min(doc_id) AS report_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN
      (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 2""")
def new_reports(t):
    rows = t.source("documents").select(F.col("doc_id").alias("report_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return plain(readers.new_reports(rows, rows.where("report_id % 10 = 0")).select("report_id", "sha256"))


@query("SRC-1_page_files", sql="SELECT page_id AS report, length(html) AS size FROM pages")
def page_files(t):
    folder = _folder(t, "pages")
    # One file per page, the page's number in its first line: a folder per page would cost as many listings as pages.
    rows = t.source("pages").selectExpr("concat(coalesce(CAST(page_id AS STRING), ''), '\n', coalesce(regexp_replace(html, '\\n', ' '), '')) AS value")
    rows.repartition(t.spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 1).text(folder)
    files = t.spark.read.format("text").option("wholetext", "true").load(folder)
    number = F.substring_index("value", "\n", 1)
    return plain(files.select(F.nullif(number, F.lit("")).cast("bigint").alias("report"),
                              (F.length("value") - F.length(number) - 2).cast("bigint").alias("size")))


@query("SNK-1_csv_export", sql="SELECT CAST(id AS VARCHAR) AS id, address_line1, state FROM d_properties")
def csv_export(t):
    folder = _folder(t, "export")
    writers.export_csv(t.properties(), folder, ["id", "address_line1", "state", "tags"])
    return plain(t.spark.read.option("header", "true").csv(folder).select("id", "address_line1", "state"))


@query("SNK-2_full_export", sql="""
    SELECT 'liens' AS name, count(*) AS rows FROM d_liens UNION ALL SELECT 'mortgages', count(*) FROM d_mortgages
    UNION ALL SELECT 'properties', count(*) FROM d_properties UNION ALL SELECT 'scores', count(*) FROM d_scores
    UNION ALL SELECT 'facts', count(*) FROM d_flags""")
def full_export(t):
    folder = _folder(t, "full")
    p = t.portfolio()
    tables = {"properties": t.properties(), "liens": p.liens, "mortgages": p.mortgages, "scores": t.scores()}
    writers.full_export(tables, t.table("d_flags"), folder)
    counts = [t.spark.read.option("header", "true").csv(f"{folder}/{name}.csv").agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
              for name in tables]
    counts.append(t.spark.read.text(f"{folder}/facts.jsonl").agg(F.lit("facts").alias("name"), F.count("*").alias("rows")))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return plain(out)


@query("SNK-3_replaced_results", sql="""
    SELECT property_id, CAST(CASE WHEN property_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, lien_type, CAST(amount AS DOUBLE) AS amount
    FROM d_liens""")
def replaced_results(t):
    folder = _folder(t, "results")
    rows = t.table("d_liens").select("property_id", "lien_type", "amount")
    writers.replace_results(rows.withColumn("version", F.lit(1)), folder, buckets=16)
    for _ in range(2):
        writers.replace_results(rows.where("property_id % 4 = 0").withColumn("version", F.lit(2)), folder, buckets=16)
    return plain(t.spark.read.parquet(folder).select("property_id", "version", "lien_type", "amount"))


@query("SNK-5_superseded_facts", sql="""
    SELECT l_orderkey AS report_id, CAST(l_linenumber AS VARCHAR) AS entity_local_id, l_orderkey % 2 <> 0 AS is_active,
      CASE WHEN l_orderkey % 2 = 0 AND l_linenumber <= 3 THEN 'new-' || l_orderkey || '-' || l_linenumber END AS superseded_by
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def superseded(t):
    base = t.source("lineitem").select("l_orderkey", "l_linenumber").distinct()
    ledger = base.selectExpr("concat('old-', l_orderkey, '-', l_linenumber) AS fact_id", "l_orderkey AS report_id",
                             "CAST(l_linenumber AS STRING) AS entity_local_id", "'a' AS field_path", "true AS is_active",
                             "CAST(NULL AS STRING) AS superseded_by")
    # Every second report is read again and finds its first three entities.
    fresh = base.where("l_orderkey % 2 = 0 AND (l_linenumber <= 3 OR l_linenumber = 7)").selectExpr(
        "concat('new-', l_orderkey, '-', l_linenumber) AS fact_id", "l_orderkey AS report_id",
        "CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_linenumber AS STRING) END AS entity_local_id", "'a' AS field_path", "true AS is_active")
    again = base.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("report_id")).distinct()
    marker = again.selectExpr("concat('mark-', report_id) AS fact_id", "report_id", "'m' AS entity_local_id", "'m' AS field_path", "true AS is_active")
    out = writers.supersede(ledger, fresh.unionByName(marker)).where("fact_id LIKE 'old-%'")
    return plain(out.select("report_id", "entity_local_id", "is_active", "superseded_by"))


@query("SNK-7_change_rows", "CHG-4", sql=f"""
    SELECT sha256(concat_ws('|', CAST(property_id AS VARCHAR), 'ownership_transfer', 'ownership.owner_names', old_value, new_value,
        '2002-01-01 00:00:00')) AS event_id, property_id, 'ownership_transfer' AS change_type, 'ownership.owner_names' AS field_path,
      '{{"value":"' || old_value || '"}}' AS old_json, '{{"value":"' || new_value || '"}}' AS new_json,
      CAST(NULL AS BIGINT) AS source_report_id, TIMESTAMP '2002-01-01 00:00:00' AS detected_at
    FROM ({OWNER_EVENTS})""")
def change_rows(t):
    return plain(writers.change_rows(changes.ownership_changes(*_snapshots(t)), datetime(2002, 1, 1)))


@query("MTH-5_amortised_balances", "MTH-1 MTH-6 DAT-1 DAT-2", sql="""
    SELECT o_orderkey, CAST(ROUND(CAST(CAST(o_totalprice AS DOUBLE) * (pow(1 + r, 360) - pow(1 + r, n)) / (pow(1 + r, 360) - 1) AS DECIMAL(28,8)), 2) AS DOUBLE) AS balance,
      CAST(n AS BIGINT) AS months, CAST(n - CASE WHEN day(o_orderdate) > 1 THEN 1 ELSE 0 END AS BIGINT) AS full_months,
      CAST(ROUND(CAST(CAST(o_totalprice AS DOUBLE) * 12 * r / (1 - pow(1 + r, -360)) AS DECIMAL(28,8)), 2) AS DOUBLE) AS yearly_service
    FROM (SELECT *, (2002 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS n, (0.03 + (o_orderkey % 5) / 100.0) / 12.0 AS r FROM orders)""")
def amortised_balances(t):
    from parcelscope.functions.dates import full_months
    from parcelscope.functions.sql import amortised_balance, calendar_months, yearly_debt_service

    day = "DATE'2002-01-01'"
    rows = t.source("orders").selectExpr("o_orderkey", "CAST(o_totalprice AS DECIMAL(16,2)) AS amount", "CAST(o_orderdate AS DATE) AS since",
                                         "CAST(0.03 + (o_orderkey % 5) * 0.01 AS DECIMAL(9,6)) AS rate", f"{day} AS until", "360 AS term")
    return plain(rows.select("o_orderkey", F.expr(amortised_balance("amount", "rate", "term", "since", "until", "'conventional'")).alias("balance"),
                             F.expr(calendar_months("since", "until")).alias("months"), full_months(F.col("since"), F.col("until")).alias("full_months"),
                             F.expr(yearly_debt_service("amount", "rate", "30")).alias("yearly_service")))


RATES = "CASE {y} WHEN 1995 THEN 0.0793 WHEN 1996 THEN 0.0781 WHEN 1997 THEN 0.0760 WHEN 1998 THEN 0.0694 WHEN 1999 THEN 0.0744 WHEN 2000 THEN 0.0805 ELSE 0.0697 END"


@query("JOI-16_historical_rates", "JOI-17", sql=f"""
    SELECT o_orderkey, CAST({RATES.format(y='year(o_orderdate)')} + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -0.0020 WHEN 2 THEN 0.0200 ELSE 0 END AS DOUBLE) AS rate,
      CAST(CASE o_custkey % 4 WHEN 0 THEN 0.0011 WHEN 1 THEN 0.0128 WHEN 2 THEN 0.0070 ELSE 0 END AS DOUBLE) AS transfer_tax FROM orders""")
def historical_rates(t):
    from parcelscope.functions.sql import historical_rate
    from parcelscope.operators.assumptions import transfer_tax

    rows = t.source("orders").selectExpr(
        "o_orderkey", "year(o_orderdate) AS y", "CASE o_orderkey % 4 WHEN 0 THEN 'conventional' WHEN 1 THEN 'fha' WHEN 2 THEN 'heloc' ELSE 'other' END AS kind",
        "CASE o_custkey % 4 WHEN 0 THEN 'ca' WHEN 1 THEN 'WA:king' WHEN 2 THEN ' FL ' ELSE 'ZZ' END AS tax_key")
    return plain(rows.selectExpr("o_orderkey", f"{historical_rate('y', 'kind')} AS rate", f"{transfer_tax('tax_key')} AS transfer_tax"))


@query("JOI-2_units_with_reports", sql="""
    SELECT d.report_id, d.batch_id, d.property_id, count(*) AS units FROM d_reports d JOIN o_units u USING (report_id) GROUP BY 1, 2, 3""")
def units_with_reports(t):
    from parcelscope.operators import documents
    from parcelscope.plans.catalog.reports import HEADERS, _pages

    units = documents.section(_pages(t), HEADERS)
    return plain(units.join(t.table("d_reports").select("report_id", "batch_id", "property_id"), "report_id")
                 .groupBy("report_id", "batch_id", "property_id").agg(F.count("*").alias("units")))


@query("SRT-9_property_ids", sql="SELECT id FROM d_properties WHERE merged_into_id IS NULL")
def property_ids(t):
    return plain(t.properties().where("merged_into_id IS NULL").select("id").orderBy("id"))


@query("AGG-2_ocr_properties", sql="""
    SELECT property_id, coalesce(bool_or(ocr_applied), false) AS ocr_applied FROM d_reports GROUP BY 1""")
def ocr_properties(t):
    return plain(t.table("d_reports").groupBy("property_id").agg(F.coalesce(F.bool_or("ocr_applied"), F.lit(False)).alias("ocr_applied")))
