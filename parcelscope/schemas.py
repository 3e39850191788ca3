"""Explicit schemas of the long-form tables; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _schema(text: str) -> str:
    """A schema as one line of DDL; it becomes a StructType once a session exists."""
    return " ".join(text.split())


FACTS = _schema("""
    fact_id string, property_id bigint, report_id bigint, extraction_unit_id bigint, entity_type string,
    entity_local_id string, field_path string, value_raw string, value_parsed decimal(20,6), value_text string,
    value_date date, value_bool boolean, unit string, as_of_date date, page_number int, snippet string,
    extraction_confidence decimal(5,4), null_reason string, source_kind string, is_active boolean
""")

# One row per property: attributes, ownership, taxes, dues, rent, condition and the data-quality block.
CORE = _schema("""
    property_id bigint, apn string, line1 string, unit string, city string, state string, zip5 string,
    county string, fips string, lat decimal(10,7), lng decimal(10,7),
    beds decimal(20,6), baths decimal(20,6), sqft decimal(20,6), lot_sqft decimal(20,6), year_built decimal(20,6),
    units decimal(20,6), owner_count bigint, entity_type string, is_owner_occupied boolean,
    is_absentee boolean, ownership_start_date date, purchase_price decimal(16,2), years_owned decimal(9,4),
    annual_taxes decimal(16,2), assessed_value decimal(16,2), delinquent_amount decimal(16,2), delinquent_years int,
    hoa_monthly_dues decimal(16,2), hoa_arrears decimal(16,2), hoa_has_lien boolean,
    rent_estimate decimal(16,2), rent_source string, condition string, condition_evidence string,
    tracked map<string,struct<confidence:decimal(5,4),source_kind:string,is_estimated:boolean,as_of:date>>,
    critical_field_coverage decimal(5,4), source_counts_by_field map<string,bigint>, conflict_count bigint,
    material_conflict_count bigint, verified_field_count bigint, ocr_applied boolean, newest_report_date date,
    mean_extraction_confidence decimal(5,4), title_flag_count bigint, has_gating_flag boolean
""")

VALUATIONS = _schema("""
    property_id bigint, seq string, valuation_type string, value decimal(16,2), value_low decimal(16,2),
    value_high decimal(16,2), as_of date, reported_confidence decimal(5,4), weight_hint decimal(18,6),
    confidence decimal(5,4), source_kind string, is_estimated boolean
""")

MORTGAGES = _schema("""
    property_id bigint, seq string, position string, lender string, original_amount decimal(16,2),
    rate decimal(9,6), term_months int, origination_date date, balance decimal(16,2),
    balance_confidence decimal(5,4), balance_is_estimated boolean, balance_method string, is_open boolean
""")

LIENS = _schema("""
    property_id bigint, seq string, lien_type string, creditor string, amount decimal(16,2),
    amount_confidence decimal(5,4), amount_is_estimated boolean, status string, attachment_basis string,
    attachment_confidence decimal(5,4), recording_date date, priority int
""")

FORECLOSURE = _schema("""
    property_id bigint, stage string, nod_date date, nts_date date, original_sale_date date, current_sale_date date,
    published_bid decimal(16,2), bid_confidence decimal(5,4), bid_is_estimated boolean,
    default_amount decimal(16,2), default_is_estimated boolean, postponement_count int, rescission_count int,
    trustee string, is_active boolean
""")

BANKRUPTCIES = _schema("""
    property_id bigint, seq string, chapter string, status string, filing_date date, discharge_date date,
    sequence int
""")

LISTINGS = _schema("""
    property_id bigint, seq string, list_date date, delist_date date, price decimal(16,2),
    price_is_estimated boolean, status string, dom int
""")

OWNERS = _schema("property_id bigint, owner_name string")

COMPARABLES = _schema("""
    property_id bigint, seq string, address string, sale_date date, price decimal(16,2), sqft decimal(20,6),
    distance decimal(20,6), similarity decimal(20,6), included boolean
""")


@dataclass(frozen=True)
class Portfolio:
    """The resolved record of every property, as long-form tables.

    ``seq`` is an ordering key of the entries of a property; owners are rows, so no list grows in a record.
    """

    core: DataFrame
    valuations: DataFrame
    mortgages: DataFrame
    liens: DataFrame
    foreclosure: DataFrame
    bankruptcies: DataFrame
    listings: DataFrame
    comparables: DataFrame
    owners: DataFrame


PORTFOLIO_SCHEMAS = {
    "core": CORE, "valuations": VALUATIONS, "mortgages": MORTGAGES, "liens": LIENS, "foreclosure": FORECLOSURE,
    "bankruptcies": BANKRUPTCIES, "listings": LISTINGS, "comparables": COMPARABLES,
    "owners": OWNERS,
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Project to a schema: known columns cast, absent columns null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in T.StructType.fromDDL(schema).fields
    ])


def portfolio(spark: SparkSession, **tables: DataFrame) -> Portfolio:
    """Build a portfolio from the tables at hand; a table that is not given is empty."""
    return Portfolio(**{
        name: conform(tables[name], schema) if tables.get(name) is not None else spark.createDataFrame([], schema)
        for name, schema in PORTFOLIO_SCHEMAS.items()
    })
