"""A fact ledger over the driver tables: every line item states the fields of one entity.

The ledger is written as a table of fields (entity, path, canonical name, kind of value, expression), in SQL
that Spark and other engines read the same way. Spark turns a line item into all of its facts in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.plans.driver_tables import Tables
from parcelscope.session import spread

PRICE = "CAST(l_extendedprice AS DECIMAL(16,2))"
DAY = "CAST(l_shipdate AS DATE)"
TEXT, NUMBER, DATE, FLAG = "txt", "num", "day", "flag"

# (line number, copies, condition, entity, path, canonical field, kind, expression). Copy 1 repeats an entity in a
# second report with slightly different figures, so that entries merge and facts corroborate each other.
FIELDS = (
    (1, 2, "true", "mortgage", "mortgages.position", "position", TEXT,
     "CASE l_suppkey % 4 WHEN 0 THEN 'First' WHEN 1 THEN '2nd' WHEN 2 THEN 'HELOC' ELSE 'first' END"),
    (1, 2, "true", "mortgage", "mortgages.lender_name", "lender", TEXT,
     "CASE WHEN l_suppkey % 3 = 0 THEN 'Wells Fargo Bank, N.A.' ELSE 'Lender ' || CAST(l_suppkey % 4 AS STRING) END"),
    (1, 2, "true", "mortgage", "mortgages.original_amount", "original_amount", NUMBER,
     f"CAST({PRICE} * 1.5 + 300 * copy AS DECIMAL(16,2))"),
    (1, 2, "l_suppkey % 9 <> 0", "mortgage", "mortgages.origination_date", "origination_date", DATE, f"{DAY} + 9 * copy"),
    (1, 2, "l_suppkey % 5 <> 0", "mortgage", "mortgages.interest_rate", "rate", NUMBER,
     "CAST(3 + l_tax * 50 AS DECIMAL(16,2))"),
    (1, 2, "l_returnflag = 'R'", "mortgage", "mortgages.current_balance", "balance", NUMBER,
     f"CAST({PRICE} + 15000 * copy AS DECIMAL(16,2))"),
    (1, 2, "l_suppkey % 7 = 0", "mortgage", "mortgages.doc_number", "recording_doc_number", TEXT,
     "'DOC-' || CAST(l_suppkey % 3 AS STRING)"),
    (1, 1, "l_suppkey % 8 = 0", "mortgage", "mortgages.status", "status", TEXT, "'Paid Off'"),
    (2, 2, "true", "lien", "liens.lien_type", "lien_type", TEXT,
     "CASE l_suppkey % 3 WHEN 0 THEN 'federal_tax' WHEN 1 THEN 'Judgment' ELSE 'hoa' END"),
    (2, 2, "true", "lien", "liens.creditor", "creditor", TEXT, "'Creditor ' || CAST(l_suppkey % 4 AS STRING)"),
    (2, 2, "l_quantity <= 44", "lien", "liens.amount", "amount", NUMBER, f"CAST({PRICE} * 0.25 + copy AS DECIMAL(16,2))"),
    (2, 2, "true", "lien", "liens.basis", "attachment_basis", TEXT,
     "CASE l_returnflag WHEN 'A' THEN 'recorded_against_property' WHEN 'N' THEN 'Owner_Named_Only' ELSE 'elsewhere' END"),
    (2, 2, "l_suppkey % 6 <> 0", "lien", "liens.recording_date", "recording_date", DATE, f"{DAY} + 3 * copy"),
    (2, 1, "true", "lien", "liens.status", "status", TEXT,
     "CASE WHEN l_linestatus = 'O' THEN 'Active' WHEN l_suppkey % 2 = 0 THEN 'released' ELSE 'satisfied' END"),
    (3, 1, "true", "valuation", "valuation.type", "valuation_type", TEXT,
     "CASE l_suppkey % 3 WHEN 0 THEN 'AVM' WHEN 1 THEN 'comp' ELSE 'assessed' END"),
    (3, 1, "l_quantity <> 13", "valuation", "valuation.estimate", "value", NUMBER,
     f"CAST(150000 + {PRICE} * 2 AS DECIMAL(16,2))"),
    (3, 1, "l_suppkey % 3 = 1", "valuation", "valuation.low", "value_low", NUMBER, f"CAST(100000 + {PRICE} AS DECIMAL(16,2))"),
    (3, 1, "l_suppkey % 3 = 1", "valuation", "valuation.high", "value_high", NUMBER,
     f"CAST(200000 + {PRICE} * 4 AS DECIMAL(16,2))"),
    (3, 1, "l_suppkey % 3 = 0", "valuation", "valuation.confidence", "reported_confidence", NUMBER,
     "CAST(1 - l_discount * 3 AS DECIMAL(16,2))"),
    (3, 1, "l_suppkey % 2 = 0", "valuation", "valuation.as_of_date", "as_of", DATE, DAY),
    (4, 2, "l_suppkey % 25 <> 0", "property", "property.apn", "apn", TEXT,
     "'APN-' || CAST(l_partkey AS STRING) || CASE WHEN l_suppkey % 20 = 1 THEN 'X' ELSE '' END"),
    (4, 1, "true", "property", "property.address.line1", "line1", TEXT,
     "CAST(1 + l_partkey % 900 AS STRING) || ' Main St'"),
    (4, 1, "true", "property", "property.address.zip", "zip5", TEXT, "CAST(90000 + l_partkey % 100 AS STRING)"),
    (4, 2, "l_suppkey % 4 <> 0", "property", "attributes.sqft", "sqft", NUMBER,
     "CAST(1000 + l_partkey % 40 * 50 + CAST(l_quantity AS INT) % 2 AS DECIMAL(16,2))"),
    (4, 1, "true", "property", "attributes.beds", "beds", NUMBER, "CAST(1 + l_suppkey % 5 AS DECIMAL(16,2))"),
    (4, 1, "l_suppkey % 3 = 0", "property", "attributes.year_built", "year_built", NUMBER,
     "CAST(1950 + l_partkey % 50 AS DECIMAL(16,2))"),
    (4, 1, "true", "property", "ownership.owner", "owner_name", TEXT, "'Owner ' || CAST(l_suppkey % 2 AS STRING)"),
    (4, 2, "l_suppkey % 2 = 0", "property", "ownership.owner_occupied", "is_owner_occupied", FLAG, "l_suppkey % 4 = 0"),
    (4, 1, "l_suppkey % 3 = 1", "property", "ownership.absentee", "is_absentee", TEXT,
     "CASE WHEN l_suppkey % 2 = 0 THEN 'Yes' ELSE 'no' END"),
    (4, 1, "l_suppkey % 5 = 0", "property", "ownership.last_sale_date", "ownership_start_date", DATE, f"{DAY} - 5000"),
    (4, 1, "l_suppkey % 5 = 0", "property", "ownership.last_sale_price", "purchase_price", NUMBER,
     f"CAST(100000 + {PRICE} AS DECIMAL(16,2))"),
    (4, 1, "l_suppkey % 7 = 0", "property", "hoa.hoa_dues", "monthly_dues", NUMBER,
     "CAST(100 + CAST(l_quantity AS INT) AS DECIMAL(16,2))"),
    (4, 1, "l_suppkey % 14 = 0", "property", "hoa.hoa_arrears", "arrears", NUMBER,
     "CAST(CAST(l_quantity AS INT) * 40 AS DECIMAL(16,2))"),
    (5, 1, "l_suppkey % 3 = 0", "foreclosure", "foreclosure.stage", "stage", TEXT,
     "CASE l_suppkey % 4 WHEN 0 THEN 'NOD' WHEN 1 THEN 'NTS' WHEN 2 THEN 'Auction' ELSE 'Cancelled' END"),
    (5, 1, "l_suppkey % 3 <> 2", "foreclosure", "foreclosure.nod_date", "nod_date", DATE, DAY),
    (5, 1, "l_suppkey % 3 = 0", "foreclosure", "foreclosure.nts_date", "nts_date", DATE, f"{DAY} + 90"),
    (5, 1, "l_suppkey % 3 = 0", "foreclosure", "foreclosure.sale_date", "current_sale_date", DATE, f"{DAY} + 120"),
    (5, 1, "l_suppkey % 6 = 0", "foreclosure", "foreclosure.bid", "published_bid", NUMBER,
     f"CAST({PRICE} * 1.2 AS DECIMAL(16,2))"),
    (5, 1, "l_suppkey % 3 = 1", "foreclosure", "foreclosure.type", "event_type", TEXT,
     "CASE WHEN l_suppkey % 2 = 0 THEN 'Postponement' ELSE 'Notice' END"),
    (5, 1, "l_suppkey % 3 = 1", "foreclosure", "foreclosure.date", "event_date", DATE, DAY),
    (6, 1, "true", "tax", "tax.annual_tax", "annual_taxes", NUMBER, f"CAST({PRICE} * 0.05 AS DECIMAL(16,2))"),
    (6, 1, "l_suppkey % 2 = 0", "tax", "tax.assessed", "assessed_value", NUMBER, f"CAST({PRICE} * 3 AS DECIMAL(16,2))"),
    (6, 1, "l_suppkey % 4 = 0", "tax", "tax.delinquent", "delinquent_amount", NUMBER, f"CAST({PRICE} * 0.02 AS DECIMAL(16,2))"),
    (6, 1, "l_suppkey % 4 = 0", "tax", "tax.delinquent_years", "delinquent_years", NUMBER,
     "CAST(CAST(l_quantity AS INT) % 4 AS DECIMAL(16,2))"),
    (6, 1, "l_suppkey % 3 = 0", "rental", "rental.monthly_rent", "rent_estimate", NUMBER,
     "CAST(1200 + CAST(l_quantity AS INT) * 20 AS DECIMAL(16,2))"),
    (6, 1, "l_suppkey % 3 = 1", "condition", "condition.level", "condition", TEXT,
     "CASE l_suppkey % 5 WHEN 0 THEN 'Cosmetic' WHEN 1 THEN 'moderate' WHEN 2 THEN 'heavy' WHEN 3 THEN 'ruined' ELSE 'gut' END"),
    (7, 1, "l_suppkey % 3 = 0", "bankruptcy", "bankruptcy.chapter", "chapter", TEXT,
     "'chapter ' || CASE WHEN l_suppkey % 2 = 0 THEN '7' ELSE '13' END"),
    (7, 1, "l_suppkey % 3 = 0", "bankruptcy", "bankruptcy.status", "status", TEXT,
     "CASE WHEN l_linestatus = 'O' THEN 'Active' ELSE 'discharged' END"),
    (7, 1, "l_suppkey % 3 = 0", "bankruptcy", "bankruptcy.date", "filing_date", DATE, DAY),
    (7, 1, "l_suppkey % 3 = 1", "listing", "listing.date", "list_date", DATE, DAY),
    (7, 1, "l_suppkey % 3 = 1", "listing", "listing.status", "status", TEXT,
     "CASE WHEN l_returnflag = 'A' THEN 'Expired' ELSE 'active' END"),
    (7, 1, "l_suppkey % 3 = 1", "listing", "listing.list_price", "price", NUMBER, f"CAST(200000 + {PRICE} AS DECIMAL(16,2))"),
    (7, 1, "l_suppkey % 3 = 2", "comp", "comp.address", "address", TEXT, "'Comp ' || CAST(l_suppkey AS STRING)"),
    (7, 1, "l_suppkey % 3 = 2", "comp", "comp.sale_price", "price", NUMBER, f"CAST(200000 + {PRICE} * 2 AS DECIMAL(16,2))"),
    (7, 1, "l_suppkey % 3 = 2", "comp", "comp.sale_date", "sale_date", DATE, DAY),
    (7, 1, "l_suppkey % 3 = 2", "comp", "comp.distance_miles", "distance", NUMBER, "CAST(l_discount * 30 AS DECIMAL(16,2))"),
    (7, 1, "l_suppkey % 3 = 2", "comp", "comp.sqft", "sqft", NUMBER, "CAST(1000 + CAST(l_quantity AS INT) * 40 AS DECIMAL(16,2))"),
)

# What a fact takes from its line item, whatever the field. ``{line1}`` facts of line 1 may be human statements.
SHARED = {
    "property_id": "l_partkey",
    "report_id": "l_orderkey + 10000000 * copy",
    "local_id": "'e' || LPAD(CAST(l_orderkey AS STRING), 9, '0') || '-' || CAST(l_linenumber AS STRING) || '-' || "
                "CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) || '-' || CAST(copy AS STRING)",
    "as_of": f"CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE {DAY} END",
    "confidence": "CAST(1 - l_discount * 4.5 AS DECIMAL(5,4))",
    "kind": "CASE WHEN l_returnflag = 'A' THEN 'report' WHEN l_returnflag = 'N' THEN 'derived' "
            "WHEN l_quantity > 47 THEN 'human' ELSE 'api' END",
}


def fact_sql() -> str:
    """The whole ledger as one SQL text over ``lineitem``."""
    parts = []
    for line, copies, condition, entity, path, leaf, kind, expression in FIELDS:
        for copy in range(copies):
            shared = ", ".join(f"{sql} AS {name}" for name, sql in SHARED.items())
            values = ", ".join(f"{expression if kind == name else f'CAST(NULL AS {sql_type})'} AS {name}"
                               for name, sql_type in ((TEXT, "STRING"), (NUMBER, "DECIMAL(20,6)"), (DATE, "DATE"),
                                                      (FLAG, "BOOLEAN")))
            parts.append(f"""SELECT {shared}, '{entity}' AS entity_type, '{path}' AS field_path, '{leaf}' AS leaf, {values}
                FROM (SELECT *, {copy} AS copy FROM {{lineitem}})
                WHERE l_linenumber = {line} AND ({condition}) AND ({copy} = 0 OR l_suppkey % 3 <> 2)""")
    return "\nUNION ALL ".join(parts)


def ledger(t: Tables, by_property: bool = False) -> DataFrame:
    """The ledger in its own schema: one pass over the line items, one generated row per fact.

    Facts are many times their line items, so facts that are to meet by property are made behind the exchange of those.
    """
    arms = []
    for line in sorted({field[0] for field in FIELDS}):
        structs = []
        for at, copies, condition, entity, path, _leaf, kind, expression in FIELDS:
            for copy in range(copies if at == line else 0):
                def value(name: str, sql_type: str, kind=kind, expression=expression, copy=copy) -> str:
                    text = expression.replace("copy", str(copy)) if kind == name else "NULL"
                    return f"CAST({text} AS {sql_type})"

                body = (f"named_struct('copy', {copy}, 'entity_type', '{entity}', 'field_path', '{path}', "
                        f"'value_text', {value(TEXT, 'STRING')}, 'value_parsed', {value(NUMBER, 'DECIMAL(20,6)')}, "
                        f"'value_date', {value(DATE, 'DATE')}, 'value_bool', {value(FLAG, 'BOOLEAN')})")
                structs.append(f"CASE WHEN ({condition}) AND ({copy} = 0 OR l_suppkey % 3 <> 2) THEN {body} END")
        arms.append(f"WHEN {line} THEN array({', '.join(structs)})")
    lines = t.source("lineitem")
    lines = lines.repartition("l_partkey") if by_property else spread(lines, "l_orderkey", "l_linenumber")
    rows = lines.selectExpr(
        "*", f"inline(array_compact(CASE l_linenumber {' '.join(arms)} END))")
    local = SHARED["local_id"]
    return rows.selectExpr(
        f"concat({local}, '|', field_path) AS fact_id", f"{SHARED['property_id']} AS property_id",
        f"{SHARED['report_id']} AS report_id", "report_id AS extraction_unit_id", "entity_type",
        f"{local} AS entity_local_id", "field_path",
        """CASE WHEN value_parsed IS NULL THEN value_text WHEN l_quantity = 7 THEN concat(CAST(value_parsed AS STRING), ' to ',
             CAST(value_parsed + 1 AS STRING)) ELSE CAST(value_parsed AS STRING) END AS value_raw""",
        "value_parsed", "value_text", "value_date", "value_bool", "CAST(NULL AS STRING) AS unit",
        f"{SHARED['as_of']} AS as_of_date", "1 AS page_number", f"concat('line ', {local}) AS snippet",
        f"{SHARED['confidence']} AS extraction_confidence", "CAST(NULL AS STRING) AS null_reason",
        f"{SHARED['kind']} AS source_kind", "l_tax < 0.075 AS is_active")


def reports(t: Tables) -> DataFrame:
    """Which properties were read by OCR."""
    return t.source("part").select(F.col("p_partkey").alias("property_id"),
                                   (F.col("p_partkey") % 5 == 0).alias("ocr_applied"))
