"""Domain tables as fixed projections of the TPC-H-like driver tables.

Each projection is written once, in SQL that Spark and other engines read the same way; source doubles become
decimals in the first projection. ``{name}`` stands for a driver table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.schemas import PORTFOLIO_SCHEMAS, Portfolio, conform
from parcelscope.session import configure

AS_OF = "2002-01-01"

# A line number can occur twice in an order, so supplier and price tell such lines apart.
LINE = """LPAD(CAST(l_orderkey * 10 + l_linenumber AS STRING), 12, '0') || '-' || CAST(l_suppkey AS STRING) || '-'
          || CAST(CAST(l_extendedprice AS DECIMAL(16,2)) AS STRING)"""

PROJECTIONS = {
    "d_core": """
        SELECT p_partkey AS property_id,
          CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'APN-' || LPAD(CAST(p_partkey AS STRING), 8, '0') END AS apn,
          CAST(1 + p_partkey % 900 AS STRING) || ' ' || p_name || CASE p_partkey % 3
            WHEN 0 THEN ' Street' WHEN 1 THEN ' Avenue' ELSE ' Rd Apt ' || CAST(p_size AS STRING) END AS line1,
          'City ' || CAST(p_size % 7 AS STRING) AS city,
          CASE p_partkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'FL' WHEN 2 THEN 'NY' WHEN 3 THEN 'TX' ELSE 'WA' END AS state,
          CAST(90000 + p_partkey % 100 AS STRING) AS zip5, '0' || CAST(p_partkey % 9 AS STRING) AS fips,
          CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(600 + p_size * 60 AS DECIMAL(20,6)) END AS sqft,
          CAST(1 + p_size % 5 AS DECIMAL(20,6)) AS beds,
          CAST(1940 + p_size AS DECIMAL(20,6)) AS year_built,
          p_brand AS owner_name,
          p_partkey % 2 = 0 AS is_owner_occupied, p_partkey % 3 = 0 AS is_absentee,
          CAST(p_size AS DECIMAL(9,4)) AS years_owned,
          CASE WHEN p_partkey % 31 = 0 THEN NULL
               ELSE CAST(p_retailprice * (250 + p_size) AS DECIMAL(16,2)) END AS purchase_price,
          CAST(p_retailprice * 4 AS DECIMAL(16,2)) AS annual_taxes,
          CASE WHEN p_partkey % 6 = 0 THEN CAST(p_retailprice * (1 + p_size % 9) AS DECIMAL(16,2)) END AS delinquent_amount,
          CASE WHEN p_partkey % 6 = 0 THEN CAST(1 + p_partkey % 4 AS INT) END AS delinquent_years,
          CASE WHEN p_partkey % 7 = 0 THEN CAST(150 + p_size AS DECIMAL(16,2)) END AS hoa_monthly_dues,
          CASE WHEN p_partkey % 14 = 0 THEN CAST(p_size * 35 AS DECIMAL(16,2)) END AS hoa_arrears,
          p_partkey % 28 = 0 AS hoa_has_lien,
          CASE WHEN p_partkey % 4 = 1 THEN CAST(p_retailprice * 2 + p_size * 10 AS DECIMAL(16,2)) END AS rent_estimate,
          CASE p_partkey % 6 WHEN 0 THEN 'cosmetic' WHEN 1 THEN 'moderate' WHEN 2 THEN 'heavy' WHEN 3 THEN 'gut'
               WHEN 4 THEN 'pristine' END AS condition,
          CAST(0.5 + CAST(p_size AS DECIMAL(4,0)) / 100 AS DECIMAL(5,4)) AS critical_field_coverage,
          p_size % 12 AS corroborated_fields,
          p_partkey % 4 AS conflict_count, p_partkey % 3 AS material_conflict_count,
          p_size % 9 AS verified_field_count,
          CASE WHEN p_partkey % 41 = 0 THEN NULL
               ELSE CAST('2002-01-01' AS DATE) - CAST(p_partkey % 30 AS INT) END AS newest_report_date,
          CAST(0.6 + CAST(p_partkey % 40 AS DECIMAL(4,0)) / 100 AS DECIMAL(5,4)) AS mean_extraction_confidence,
          p_partkey % 2 AS title_flag_count, p_partkey % 37 = 0 AS has_gating_flag
        FROM {part}""",
    "d_valuations": """
        SELECT p_partkey AS property_id, '1' AS seq, 'avm' AS valuation_type,
          CAST(p_retailprice * 400 AS DECIMAL(16,2)) AS value, CAST(NULL AS DECIMAL(16,2)) AS value_low,
          CAST(NULL AS DECIMAL(16,2)) AS value_high, CAST('2001-12-31' AS DATE) - CAST(p_size * 3 AS INT) AS as_of,
          CAST(0.5 + CAST(p_size AS DECIMAL(4,0)) / 100 AS DECIMAL(5,4)) AS reported_confidence,
          CAST(0.9 AS DECIMAL(5,4)) AS confidence, true AS is_estimated
        FROM {part} WHERE p_partkey % 13 <> 0
        UNION ALL
        SELECT p_partkey, '2', 'comp', CAST(p_retailprice * (350 + p_size * 4) AS DECIMAL(16,2)),
          CAST(p_retailprice * 320 AS DECIMAL(16,2)), CAST(p_retailprice * 600 AS DECIMAL(16,2)),
          CAST('2001-11-30' AS DATE) - CAST(p_size AS INT), CAST(NULL AS DECIMAL(5,4)),
          CAST(0.6 + CAST(p_size AS DECIMAL(4,0)) / 200 AS DECIMAL(5,4)), false
        FROM {part} WHERE p_partkey % 11 <> 0
        UNION ALL
        SELECT p_partkey, '3', 'assessed', CAST(p_retailprice * (200 + p_size * 5) AS DECIMAL(16,2)),
          CAST(NULL AS DECIMAL(16,2)), CAST(NULL AS DECIMAL(16,2)), CAST('2001-01-01' AS DATE),
          CAST(NULL AS DECIMAL(5,4)), CAST(0.95 AS DECIMAL(5,4)), false
        FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey % 13 <> 0""",
    "d_mortgages": f"""
        SELECT l_partkey AS property_id, {LINE} AS seq,
          CASE l_suppkey % 4 WHEN 0 THEN 'First' WHEN 1 THEN '2nd' WHEN 2 THEN 'HELOC' ELSE 'first' END AS position,
          'Lender ' || CAST(l_suppkey % 20 AS STRING) AS lender,
          CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 1.5 AS DECIMAL(16,2)) AS original_amount,
          CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(0.03 + l_tax AS DECIMAL(9,6)) END AS rate,
          CASE WHEN l_suppkey % 3 = 0 THEN 180 END AS term_months,
          CAST(l_shipdate AS DATE) AS origination_date,
          CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(16,2)) END AS balance,
          CAST(1 - l_discount * 4 AS DECIMAL(5,4)) AS balance_confidence, l_linestatus = 'F' AS balance_is_estimated,
          l_suppkey % 4 <> 3 AS is_open
        FROM {{lineitem}} WHERE l_linenumber % 4 = 1""",
    "d_liens": f"""
        SELECT l_partkey AS property_id, {LINE} AS seq,
          CASE l_suppkey % 6 WHEN 0 THEN 'federal_tax' WHEN 1 THEN 'judgment' WHEN 2 THEN 'hoa' WHEN 3 THEN 'mechanics'
               WHEN 4 THEN 'state_tax' ELSE 'child_support' END AS lien_type,
          'Creditor ' || CAST(l_suppkey AS STRING) AS creditor,
          CASE WHEN l_quantity > 44 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 0.25 AS DECIMAL(16,2)) END AS amount,
          CAST(1 - l_discount * 5 AS DECIMAL(5,4)) AS amount_confidence, l_tax > 0.05 AS amount_is_estimated,
          CASE WHEN l_linestatus = 'O' THEN 'active' WHEN l_returnflag = 'A' THEN 'satisfied'
               WHEN l_returnflag = 'N' THEN 'released' ELSE 'unknown' END AS status,
          CASE l_returnflag WHEN 'A' THEN 'recorded_against_property' WHEN 'N' THEN 'owner_named_only'
               ELSE 'unknown' END AS attachment_basis,
          CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS recording_date
        FROM {{lineitem}} WHERE l_linenumber % 4 = 2""",
    "d_foreclosure": """
        SELECT p_partkey AS property_id,
          CASE p_size % 5 WHEN 0 THEN 'nod' WHEN 1 THEN 'nts' WHEN 2 THEN 'auction' WHEN 3 THEN 'cancelled'
               ELSE 'sold' END AS stage,
          CASE WHEN p_partkey % 8 <> 0 THEN CAST('2001-06-01' AS DATE) - CAST(p_size AS INT) END AS nod_date,
          CASE WHEN p_size % 2 = 0 THEN CAST('2001-12-30' AS DATE) - CAST(p_size * 2 AS INT) END AS nts_date,
          CAST('2002-02-01' AS DATE) AS original_sale_date,
          CAST('2002-02-20' AS DATE) - CAST(p_size AS INT) AS current_sale_date,
          CASE WHEN p_size % 4 <> 3 THEN CAST(p_retailprice * (50 + p_size) AS DECIMAL(16,2)) END AS published_bid,
          CAST(0.5 + CAST(p_size AS DECIMAL(4,0)) / 100 AS DECIMAL(5,4)) AS bid_confidence,
          false AS bid_is_estimated,
          CAST(p_size % 5 AS INT) AS postponement_count, CAST(p_size % 4 AS INT) AS rescission_count,
          p_size % 5 < 3 AS is_active
        FROM {part} WHERE p_partkey % 4 = 0""",
    "d_bankruptcies": """
        SELECT o_custkey AS property_id, LPAD(CAST(o_orderkey AS STRING), 12, '0') AS seq,
          CASE o_orderkey % 3 WHEN 0 THEN '7' WHEN 1 THEN '11' ELSE '13' END AS chapter,
          CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'discharged'
               WHEN 3 THEN 'closed' ELSE 'filed' END AS status,
          CAST(o_orderdate AS DATE) AS filing_date,
          CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_orderdate AS DATE) + 120 END AS discharge_date,
          CAST(1 + o_orderkey % 2 AS INT) AS sequence
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "d_listings": """
        SELECT o_custkey AS property_id, LPAD(CAST(o_orderkey AS STRING), 12, '0') AS seq, CAST(o_orderdate AS DATE) AS list_date,
          CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS delist_date,
          CAST(o_totalprice AS DECIMAL(16,2)) AS price, false AS price_is_estimated,
          CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'expired' WHEN 2 THEN 'cancelled' ELSE 'sold' END AS status,
          CAST(o_orderkey % 200 AS INT) AS dom
        FROM {orders} WHERE o_orderstatus <> 'F'""",
    "d_comparables": f"""
        SELECT l_partkey AS property_id, {LINE} AS seq, 'Comp ' || CAST(l_suppkey AS STRING) AS address,
          CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS sale_date,
          CASE WHEN l_quantity > 47 THEN NULL ELSE CAST(300000 + l_extendedprice * 2 AS DECIMAL(16,2)) END AS price,
          CAST(700 + l_quantity * 50 AS DECIMAL(20,6)) AS sqft, CAST(l_discount * 30 AS DECIMAL(20,6)) AS distance,
          l_returnflag <> 'N' AS included
        FROM {{lineitem}} WHERE l_linenumber % 4 = 3""",
    "d_owners": """
        SELECT p_partkey AS property_id, p_brand AS owner_name FROM {part}
        UNION ALL SELECT p_partkey, p_type FROM {part} WHERE p_partkey % 4 = 0""",
    "d_scores": """
        SELECT o_orderkey AS score_id, o_custkey AS property_id, CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.0002 AS DECIMAL(9,4)) AS overall,
          CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS computed_on,
          CASE o_orderkey % 9 WHEN 0 THEN 'insufficient_data' WHEN 1 THEN 'dcs_below_40' WHEN 2 THEN 'open_gating_flag'
               END AS gate, o_orderstatus AS batch
        FROM {orders}""",
    "d_flags": """
        SELECT l_orderkey * 10 + l_linenumber AS flag_no, l_partkey AS property_id,
          CASE l_suppkey % 6 WHEN 0 THEN 'identity_conflict' WHEN 1 THEN 'lien_attachment' WHEN 2 THEN 'missing_apn'
               WHEN 3 THEN 'bid_mismatch' WHEN 4 THEN 'conflicting_mortgage' ELSE 'range_violation' END AS flag_type,
          CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(16,2)) END AS impact,
          CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'resolved' END AS status,
          'flag:' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey % 10 AS STRING) AS dedupe_key,
          CAST(l_shipdate AS DATE) AS raised_on
        FROM {lineitem} WHERE l_linenumber % 4 = 0""",
    "d_properties": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'APN-' || CAST(p_partkey AS STRING) END AS apn,
          CAST(1 + p_partkey % 900 AS STRING) || ' ' || p_name AS address_line1, 'City ' || CAST(p_size % 7 AS STRING) AS city,
          CASE p_partkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'FL' ELSE 'NY' END AS state,
          CAST(90000 + p_partkey % 100 AS STRING) AS zip5,
          CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'new' WHEN 2 THEN 'offer' WHEN 3 THEN 'closed' ELSE 'dead' END AS pipeline_status,
          p_type AS tag, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS other_tag,
          CASE WHEN p_partkey % 6 = 0 THEN 'call' END AS next_action,
          CASE WHEN p_partkey % 6 = 0 THEN CAST('2002-01-01' AS DATE) + CAST(p_size AS INT) END AS next_action_date,
          CASE WHEN p_partkey % 7 <> 0 THEN CAST(1 + p_partkey % 5 AS INT) END AS gut_rating,
          CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_watchlisted,
          CAST(30 + CAST(p_size AS DECIMAL(6,2)) / 10 AS DECIMAL(10,7)) AS lat,
          CAST('2001-01-01' AS DATE) + CAST(p_partkey % 365 AS INT) AS created_on,
          CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1 END AS merged_into_id
        FROM {part}""",
    "d_deals": """
        SELECT o_orderkey AS deal_id, o_custkey AS property_id,
          CASE o_orderkey % 7 WHEN 0 THEN 'dead' WHEN 1 THEN 'loss' ELSE 'sold' END AS outcome,
          CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.6 AS DECIMAL(16,2)) AS purchase_price,
          CASE WHEN o_orderkey % 11 <> 0 THEN CAST(5000 + o_orderkey % 100 * 300 AS DECIMAL(16,2)) END AS actual_repairs,
          CAST(2000 + o_custkey % 50 * 100 AS DECIMAL(16,2)) AS actual_costs, CAST(o_totalprice AS DECIMAL(16,2)) AS sale_price,
          CAST(90 + o_orderkey % 120 AS INT) AS actual_holding_days, CAST(o_orderdate AS DATE) AS closed_on,
          CASE o_custkey % 6 WHEN 0 THEN 'cosmetic' WHEN 1 THEN 'moderate' WHEN 2 THEN 'heavy' WHEN 3 THEN 'gut' WHEN 4 THEN 'pristine' END AS condition,
          CAST(6000 + o_custkey % 90 * 250 AS DECIMAL(16,2)) AS predicted_repairs,
          CASE WHEN o_custkey % 8 <> 0 THEN CAST(100 + o_custkey % 90 AS INT) END AS predicted_holding_days,
          CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.0002 AS DECIMAL(9,4)) AS overall_score,
          CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1 + o_orderkey % 5 AS INT) END AS gut_rating,
          CAST(CAST(o_totalprice AS DECIMAL(16,2)) * (CAST(90 + o_orderkey % 20 AS DECIMAL(6,0)) * 0.01) AS DECIMAL(16,2)) AS predicted_avm,
          CAST(CAST(o_totalprice AS DECIMAL(16,2)) * (CAST(95 + o_orderkey % 8 AS DECIMAL(6,0)) * 0.01) AS DECIMAL(16,2)) AS predicted_comp,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.7 AS DECIMAL(16,2)) END AS predicted_assessed,
          CAST(o_orderkey % 100 AS DECIMAL(9,4)) AS fos, CAST(o_custkey % 60 AS DECIMAL(9,4)) AS distress,
          CAST(50 + o_orderkey % 40 AS DECIMAL(9,4)) AS dcs, CAST(o_orderkey % 30 AS DECIMAL(9,4)) AS risk
        FROM {orders}""",
    "d_reports": """
        SELECT doc_id AS report_id, source AS batch_id, CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS property_id, doc_id % 7 = 0 AS ocr_applied,
          CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' ELSE 'ingested' END AS status,
          lang AS vendor, n_chars, text
        FROM {documents}""",
}


class Tables:
    """The driver tables of one scale, and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def state(self) -> tuple:
        """What the files of the folder are just now: a result kept for a session holds while this stays the same."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        row = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()
        return self.spark.sparkContext.applicationId, self.folder, row[0], row[1]

    def sql(self, text: str) -> DataFrame:
        """Run a projection with ``{table}`` bound to the parquet file of that table."""
        names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")
        return self.spark.sql(text.format(**{name: f"parquet.`{self.folder}/{name}.parquet`" for name in names}))

    def table(self, name: str) -> DataFrame:
        return self.sql(PROJECTIONS[name])

    def scores(self) -> DataFrame:
        return self.table("d_scores").select(
            "score_id", "property_id", "overall", F.col("computed_on").cast("timestamp").alias("computed_at"),
            F.array_compact(F.array("gate")).alias("gates_applied"), "batch")

    def properties(self) -> DataFrame:
        return self.table("d_properties").select(
            "id", "apn", "address_line1", "city", "state", "zip5", "pipeline_status",
            F.array_compact(F.array("tag", "other_tag")).alias("tags"), "next_action", "next_action_date", "gut_rating",
            "is_watchlisted", "lat", F.lit(None).cast("decimal(10,7)").alias("lng"),
            F.col("created_on").cast("timestamp").alias("created_at"), F.col("created_on").cast("timestamp").alias("updated_at"),
            "merged_into_id")

    def deals(self) -> DataFrame:
        deals = self.table("d_deals")
        predictions = F.create_map(F.lit("avm"), "predicted_avm", F.lit("comp"), "predicted_comp", F.lit("assessed"), "predicted_assessed")
        pillars = F.create_map(*[cell for name in ("fos", "distress", "dcs", "risk") for cell in (F.lit(name), F.col(name))])
        return deals.withColumns({"valuation_predictions": predictions, "pillar_scores": pillars,
                                  "closed_at": F.col("closed_on").cast("timestamp")})

    def portfolio(self) -> Portfolio:
        frames = {name: self.table(f"d_{name}") for name in PORTFOLIO_SCHEMAS}
        counts = F.when(F.col("corroborated_fields") > 0, F.map_from_entries(F.transform(
            F.sequence(F.lit(1), F.col("corroborated_fields")),
            lambda n: F.struct(F.concat(F.lit("field"), n.cast("string")), F.lit(2).cast("bigint")))))
        frames["core"] = frames["core"].withColumn("source_counts_by_field", counts)
        return Portfolio(**{name: conform(frame, PORTFOLIO_SCHEMAS[name]) for name, frame in frames.items()})
