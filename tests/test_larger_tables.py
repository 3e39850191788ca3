"""What shows only on larger tables: tables of many files, figures of many digits, plans that would send rows through the driver."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import compare
from parcelscope.operators import analyst, identity, nearest
from parcelscope.operators.linking import components_within
from parcelscope.plans import catalog
from parcelscope.plans.catalog import flows, records
from parcelscope.plans.driver_tables import Tables

FOLDER = Path("/root/testdata/sf0.001")
QUERIES = catalog.load()


@pytest.mark.parametrize("name", ["STM-2_first_of_each_content", "STM-4_budget_stream"])
def test_streams_of_a_table_of_several_files(spark, tmp_path, name):
    spark.read.parquet(str(FOLDER / "documents.parquet")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, wanted = compare(spark, connection, QUERIES[name], str(tmp_path))
    assert wanted and got == wanted


def test_numbers_of_any_length_are_counted_and_checked(spark, tmp_path):
    texts = [(1, "12 and 123456789012345678901234567890, $1,000.5%"), (2, "none"), (3, None), (4, "9" * 60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, wanted = compare(spark, connection, QUERIES["STR-18_numbers_in_text"], str(tmp_path))
    assert got == wanted
    payload = spark.createDataFrame([(1, 12), (4, 12)], "id long, number long")
    judged = analyst.numbers_allowed(spark.createDataFrame([(1, "12"), (4, "12 " + "9" * 60)], "id long, text string"), payload)
    assert {row.id: (row.numbers, row.is_valid) for row in judged.collect()} == {1: (1, True), 4: (2, False)}


def test_sets_of_grams_are_not_sent_through_the_driver(spark):
    names = spark.range(50).select(F.lit("n").alias("block"), F.format_string("Customer#%09d", "id").alias("text"), F.col("id").alias("key"))
    subjects = names.select(F.col("key").alias("subject"), "block", "text", F.lit(None).cast("long").alias("before"), F.col("key").alias("own"))
    plan = nearest.nearest_texts(subjects, names, 0.8, identity.best_matches)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan and re.search(r"BroadcastHashJoin \[block#\d+L?, other#\d+L?, part#", plan) is None


def test_validated_facts_are_not_exchanged_or_written(spark):
    """Facts are many times their responses: what is exchanged stands below the step that makes them."""
    plan = QUERIES["EXT-2_validated_facts"].run(Tables(spark, str(FOLDER)))._jdf.queryExecution().executedPlan().toString()
    above, made, _ = plan.partition("Generate")
    assert made and "Exchange" not in above


def test_scored_facts_are_not_exchanged(spark):
    """Line items are dealt by property; the facts made from them meet there, and stored ones are read as they were dealt."""
    tables = Tables(spark, str(FOLDER))
    plan = QUERIES["RES-1_precedence_scores"].run(tables)._jdf.queryExecution().executedPlan().toString()
    above, made, _ = plan.partition("Generate")
    assert made and "Exchange" not in above
    stored = records.resolved(tables).scored.groupBy("property_id", "entity_key").agg(F.count("*"))
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()


def test_owners_are_solved_across_batches(spark):
    edges = [(f"o{at % 7}", f"o{at % 7}-{at // 7 + 1:03d}", f"o{at % 7}-{at // 7:03d}") for at in range(210)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = components_within(spark.createDataFrame(edges, "owner string, u string, v string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(row) for row in got} == {(f"o{owner}-{at:03d}", f"o{owner}-000") for owner in range(7) for at in range(31)}


def test_score_terms_are_compared_inside_the_rows_of_a_pair(spark):
    terms = [(1, 60.0, {"fos_roi_norm": 3.0, "risk_liens": 2.0, "dcs_recency": 1.0, "other": 9.0}), (2, 50.0, {"fos_roi_norm": 1.0, "risk_hoa_arrears": 4.0})]
    scores = spark.createDataFrame(terms, "property_id long, overall double, components map<string, double>").withColumn(
        "overall", F.col("overall").cast("decimal(9,4)")).withColumn("components", F.col("components").cast("map<string, decimal(18,6)>"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a_id long, b_id long")
    rows = analyst.term_deltas(pairs, scores)
    assert {(row.a_id, row.name): float(row.point_delta) for row in rows.collect()} == {
        (1, "fos_roi_norm"): 2, (1, "risk_liens"): -2, (1, "dcs_recency"): 1, (1, "risk_hoa_arrears"): 4, (2, "fos_roi_norm"): 1, (2, "risk_hoa_arrears"): -4}
    drivers = analyst.top_drivers(pairs, scores, 2)
    assert [(r.place, r.name) for r in drivers.where("a_id = 1").orderBy("place").collect()] == [(1, "risk_hoa_arrears"), (2, "fos_roi_norm")]
    explained = analyst.explanations(pairs, scores)
    assert [row.a_id for row in explained.collect()] == [1]
    # One join per side; terms are neither exchanged one by one nor sorted over the table.
    for frame, joins in ((rows, 2), (drivers, 2), (explained, 2)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"\bJoin\b", plan)) == joins and "Window" not in plan and "Aggregate" not in plan


def test_page_files_share_one_folder(spark, tmp_path, monkeypatch):
    pages = [(at, f"<p>{at}\n\nx</p>\r\n") for at in range(20)] + [(20, ""), (21, "7\n8")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(flows, "_folder", lambda t, label: str(tmp_path / label))
    rows = QUERIES["SRC-1_page_files"].run(Tables(spark, str(tmp_path))).collect()
    assert {(row.report, row["size"]) for row in rows} == {(number, len(html)) for number, html in pages}
    assert len(list((tmp_path / "pages").glob("*.txt"))) == len(pages) and not [path for path in (tmp_path / "pages").iterdir() if path.is_dir()]


def test_a_task_reads_few_rows_of_a_large_exchange(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(12_000_000).select("id", F.rand(1).alias("x")).repartition("id")
        assert rows.select(F.spark_partition_id().alias("task"), "x").groupBy("task").agg(F.sum("x")).count() > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["SRT-8_top_two_offers", "SNK-10_net_sheets"])
def test_a_report_makes_only_the_figures_it_reads(spark, name):
    """No other result table is made or written for it: the plan starts at the driver tables and knows nothing of rents."""
    plan = QUERIES[name].run(Tables(spark, str(FOLDER)))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" in plan and "scenario-rows" not in plan
    assert "rental_service" not in plan and "auction_holding" not in plan


def _method_sizes(spark, frame) -> list[int]:
    """Bytes of the largest generated method of every compiled part of a plan."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", frame._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_methods_of_validated_facts_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes, which takes several times as long per fact."""
    sizes = _method_sizes(spark, QUERIES["EXT-2_validated_facts"].run(Tables(spark, str(FOLDER))))
    assert sizes and max(sizes) <= 8000


def test_facts_are_judged_once_for_their_grades(spark):
    """Both sides of the comparison read the stored facts, and a repeated expectation is counted without another pass."""
    plan = QUERIES["EXT-5_field_accuracy"].run(Tables(spark, str(FOLDER)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and len(re.findall(r"\bJoin\b", plan)) == 1


def test_one_sort_serves_the_windows_of_agreement(spark):
    plan = QUERIES["RES-1_precedence_scores"].run(Tables(spark, str(FOLDER)))._jdf.queryExecution().executedPlan().toString()
    above, made, _ = plan.partition("Generate")
    assert made and above.count("Window [") == 3 and above.count("Sort [") == 1
