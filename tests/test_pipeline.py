"""Ledger to ranking in one run, and the tables it is stored in."""

import json
from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from parcelscope.operators import analyst, documents, extraction
from parcelscope.operators.assumptions import Assumptions
from parcelscope.operators.ranking import RANKINGS
from parcelscope.plans.recompute import recompute_from_facts
from parcelscope.sources import readers, writers
from test_resolution import AS_OF, fact, ledger, mortgage


def house(property_id, value, sqft="1400"):
    return [
        fact(property_id, property_id, "property", "p", "property.apn", value_text=f"APN-{property_id}"),
        fact(property_id, property_id, "property", "p", "attributes.sqft", value_parsed=D(sqft)),
        fact(property_id, property_id, "property", "p", "ownership.last_sale_price", value_parsed=D("200000")),
        fact(property_id, property_id, "valuation", "v", "valuation.type", value_text="comp"),
        fact(property_id, property_id, "valuation", "v", "valuation.estimate", value_parsed=D(value)),
        fact(property_id, property_id, "condition", "c", "condition.level", value_text="cosmetic"),
        *mortgage(property_id, property_id, "m", "150000", date(2020, 1, 1)),
    ]


def test_ledger_to_ranking(spark):
    facts = ledger(spark, [*house(1, "300000"), *house(2, "500000"), *house(3, "400000"),
                           fact(4, 4, "property", "p", "property.apn", value_text="APN-4")])
    none = spark.createDataFrame([], RANKINGS)
    _, results, ranks = recompute_from_facts(facts, None, Assumptions(), AS_OF, none, datetime(2026, 8, 1))
    order = [row.property_id for row in ranks.orderBy("rank").collect()]
    assert order == [2, 3, 1]
    gates = {row.property_id: row.gates_applied for row in results.scores.collect()}
    assert gates[4][0] == "insufficient_data"
    assert results.strategies.count() == 4 * 18 and results.underwriting.count() == 4 * 3
    assert results.offers.groupBy("property_id").count().where("count <> 33").count() == 0
    # The same ledger again, and in another order, gives the same results.
    _, again, second = recompute_from_facts(facts.orderBy(F.rand(3)), None, Assumptions(), AS_OF, ranks, datetime(2026, 8, 2))
    key = ("property_id", "overall", "fos", "distress", "risk")
    assert sorted(again.scores.select(*key).collect()) == sorted(results.scores.select(*key).collect())
    assert second.where("prev_rank <> rank").count() == 0
    risks = results.scores.withColumn("risks", analyst.key_risks()).collect()
    assert all(row.risks[:len(row.gates_applied)] == row.gates_applied for row in risks)


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts = ledger(spark, house(1, "300000"))
    writers.append_facts(facts, path)
    writers.append_facts(facts, path)
    assert spark.read.parquet(path).count() == facts.count()
    snapshot = spark.createDataFrame([("portfolio", None, 1, 1, None, D("50"), datetime(2026, 1, 1))], RANKINGS)
    writers.append_snapshot(snapshot, str(tmp_path / "rankings"))
    assert spark.read.parquet(str(tmp_path / "rankings")).count() == 1
    properties = spark.createDataFrame([(1, None, None), (2, "old", None)],
                                       "property_id long, underwriting_status string, last_recomputed_at timestamp")
    done = spark.createDataFrame([(1, "expected", "ok")], "property_id long, scenario string, status string")
    rows = {row.property_id: row for row in writers.mark_recomputed(properties, done, datetime(2026, 1, 1)).collect()}
    assert rows[1].underwriting_status == "ok" and rows[1].last_recomputed_at is not None
    assert rows[2].underwriting_status == "old" and rows[2].last_recomputed_at is None


def test_recorded_files_and_costs(spark, tmp_path):
    leaf = {"entity_type": "lien", "entity_local_id": "l", "field_path": "liens.amount", "value_raw": "$5", "value_parsed": "5", "page_number": 2,
            "snippet": "owes $5", "extraction_confidence": 0.9}
    (tmp_path / "a.json").write_text(json.dumps({"response_id": "a", "model": "gpt-4o", "unit_type": "liens", "response": {"facts": [leaf]}}))
    responses = readers.read_responses(spark, str(tmp_path))
    units = spark.createDataFrame([("a", 1, 3, "He OWES  $5 now")], "report_id string, page_start int, page_end int, text string")
    rows = extraction.validate(extraction.legacy_facts(responses), extraction.unit_pages(units), date(2026, 1, 1)).collect()
    assert len(rows) == 1 and rows[0].outcome is None and rows[0].is_active
    usage = spark.createDataFrame([("gpt-4o", 1000, 100), ("gpt-4o-mini", 1000, 100), ("new", 1000, 0)],
                                  "model string, prompt_tokens long, completion_tokens long")
    assert [row.cost_usd for row in documents.usage_costs(usage).collect()] == [D("0.003500"), D("0.000210"), D("0.002500")]
