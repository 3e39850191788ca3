"""Flags and change events."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from parcelscope.operators import changes, flags
from parcelscope.operators.assumptions import Assumptions
from parcelscope.plans.catalog import STEPS, plain, query, step
from parcelscope.plans.driver_tables import AS_OF, PROJECTIONS
from parcelscope.schemas import PORTFOLIO_SCHEMAS, conform

DAY = date.fromisoformat(AS_OF)

step("o_known", "SELECT property_id, true AS has_value FROM o_blend")
step("o_flag_mortgages", """
    SELECT property_id, pos, arg_min(balance, row(-balance, seq)) AS high, min(balance) AS low, count(*) AS n,
      arg_min(original_amount, row(-balance, seq)) AS high_original, arg_min(seq, row(-balance, seq)) AS high_seq
    FROM o_open WHERE is_open AND balance IS NOT NULL GROUP BY 1, 2
    HAVING count(*) > 1 AND max(balance) - min(balance) > greatest(0.05 * max(balance), 10000)""")
step("o_flags", """
    SELECT property_id, 'lien_attachment' AS flag_type, CASE WHEN has_value THEN amount END AS impact FROM d_liens
      LEFT JOIN o_known USING (property_id) WHERE status NOT IN ('released', 'satisfied') AND amount >= 10000
      AND attachment_basis <> 'recorded_against_property'
    UNION ALL SELECT property_id, 'missing_lien_amount', CASE WHEN has_value THEN ROUND(
        CASE lien_type WHEN 'hoa' THEN 4500 WHEN 'mechanics' THEN 12000 WHEN 'judgment' THEN 18000 END
        * CASE attachment_basis WHEN 'owner_named_only' THEN 0.35 WHEN 'unknown' THEN 0.50 ELSE 1 END, 2) END
      FROM d_liens LEFT JOIN o_known USING (property_id) WHERE status NOT IN ('released', 'satisfied') AND amount IS NULL
    UNION ALL SELECT property_id, 'conflicting_mortgage', NULL FROM d_core WHERE material_conflict_count > 0
    UNION ALL SELECT f.property_id, 'conflicting_mortgage', CASE WHEN k.has_value THEN CASE WHEN f.pos = '1' AND b.bid IS NOT NULL THEN 0
        WHEN f.pos = 'HELOC' THEN abs(greatest(high, high_original) - (SELECT arg_min(greatest(balance, original_amount), row(-balance, seq))
             FROM o_open o WHERE o.property_id = f.property_id AND o.pos = f.pos AND is_open AND balance IS NOT NULL AND seq <> high_seq))
        ELSE abs(high - (SELECT max(balance) FROM o_open o WHERE o.property_id = f.property_id AND o.pos = f.pos AND is_open
             AND seq <> high_seq)) END END
      FROM o_flag_mortgages f LEFT JOIN o_bids b USING (property_id) LEFT JOIN o_known k USING (property_id)
    UNION ALL SELECT property_id, 'foreclosure_unclear', NULL FROM d_foreclosure
      WHERE (nts_date IS NOT NULL AND nod_date IS NULL) OR nts_date < nod_date OR current_sale_date < original_sale_date
    UNION ALL SELECT property_id, 'valuation_dispersion', max(value) - min(value) FROM d_valuations GROUP BY 1
      HAVING count(*) > 1 AND max(value) > 1.5 * min(value)
    UNION ALL SELECT property_id, 'missing_apn', NULL FROM d_core WHERE apn IS NULL
    UNION ALL SELECT DISTINCT property_id, 'low_extraction_confidence', CAST(NULL AS DECIMAL(16,2)) FROM (
        SELECT property_id, confidence AS c FROM d_valuations UNION ALL SELECT property_id, balance_confidence FROM d_mortgages
          WHERE balance IS NOT NULL UNION ALL SELECT property_id, amount_confidence FROM d_liens WHERE amount IS NOT NULL
        UNION ALL SELECT property_id, bid_confidence FROM d_foreclosure WHERE published_bid IS NOT NULL) WHERE c < 0.65
    UNION ALL SELECT f.property_id, 'bid_mismatch', CASE WHEN has_value THEN CASE WHEN is_active THEN abs(published_bid - highest) ELSE 0 END END
      FROM d_foreclosure f JOIN (SELECT property_id, arg_min(balance, seq) AS balance, max(balance) AS highest FROM o_open
        WHERE is_open AND pos = '1' AND balance IS NOT NULL GROUP BY 1) m USING (property_id) LEFT JOIN o_known USING (property_id)
      WHERE published_bid > 0 AND abs(published_bid - balance) > 0.20 * published_bid
    UNION ALL SELECT property_id, 'range_violation', NULL FROM (
        SELECT property_id, sqft NOT BETWEEN 100 AND 100000 AS bad FROM d_core UNION ALL SELECT property_id, beds NOT BETWEEN 0 AND 30 FROM d_core
        UNION ALL SELECT property_id, year_built NOT BETWEEN 1600 AND 2004 FROM d_core
        UNION ALL SELECT property_id, value NOT BETWEEN 1000 AND 100000000 FROM d_valuations
        UNION ALL SELECT property_id, amount NOT BETWEEN 1 AND 50000000 FROM d_liens) WHERE bad""")


@query("FLG-11_flags_with_impact", "FLG-2 FLG-3 FLG-4 FLG-5 FLG-6 FLG-7 FLG-8 FLG-9 FLG-10 SET-2", sql="""
    SELECT property_id, flag_type, CAST(impact AS DOUBLE) AS impact FROM o_flags""")
def flags_with_impact(t):
    return plain(flags.collect_flags(t.portfolio(), Assumptions(), DAY).select("property_id", "flag_type", "impact"))


@query("FLG-1_identity_conflicts", sql="""
    SELECT property_id, concat_ws(',', CASE WHEN a.apn > 1 THEN 'address' END, CASE WHEN a.line > 1 THEN 'apn' END) AS subject FROM (
      SELECT l_partkey AS property_id, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 4) AS apn,
        count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 5) AS line FROM lineitem GROUP BY 1) a JOIN d_core USING (property_id)
    WHERE conflict_count > 0 AND (a.apn > 1 OR a.line > 1)""")
def identity_conflicts(t):
    stated = t.source("lineitem").groupBy(F.col("l_partkey").alias("property_id")).agg(F.expr("""map(
        'address', count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 4),
        'apn', count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 5)) AS source_counts_by_field"""))
    p = t.portfolio()
    core = p.core.drop("source_counts_by_field").join(stated, "property_id")
    return plain(flags.identity_flags(replace(p, core=conform(core, PORTFOLIO_SCHEMAS["core"]))).select("property_id", "subject"))


@query("FLG-13_gating_summary", sql="""
    SELECT property_id, count(*) AS flags, bool_or(flag_type = 'identity_conflict') AS has_gating_flag,
      count(*) FILTER (WHERE flag_type IN ('identity_conflict', 'conflicting_mortgage', 'foreclosure_unclear')) AS title_flag_count,
      CAST(max(impact) AS DOUBLE) AS largest_impact FROM o_flags GROUP BY 1""")
def gating_summary(t):
    return plain(flags.gating_summary(flags.collect_flags(t.portfolio(), Assumptions(), DAY)))


step("o_flag_requests", """
    SELECT l_partkey AS property_id, 'flag:' || l_partkey || ':' || l_suppkey % 10 AS dedupe_key,
      CASE WHEN l_suppkey % 2 = 0 THEN 'lien_attachment' ELSE 'missing_apn' END AS flag_type, CAST(l_extendedprice AS DECIMAL(16,2)) AS impact
    FROM lineitem WHERE l_linenumber % 4 <> 0""")


@query("SNK-6_flag_upsert", sql="""
    SELECT dedupe_key, property_id, arg_min(flag_type, row(flag_type, -impact)) AS flag_type,
      CAST(arg_min(impact, row(flag_type, -impact)) AS DOUBLE) AS impact FROM o_flag_requests
    WHERE dedupe_key NOT IN (SELECT dedupe_key FROM d_flags) GROUP BY 1, 2""")
def flag_upsert(t):
    requests = t.source("lineitem").where("l_linenumber % 4 <> 0").selectExpr(
        "l_partkey AS property_id", "CASE WHEN l_suppkey % 2 = 0 THEN 'lien_attachment' ELSE 'missing_apn' END AS flag_type",
        "CAST(NULL AS STRING) AS subject", "CAST(l_extendedprice AS DECIMAL(16,2)) AS impact", "'flags' AS raised_by",
        "concat('flag:', l_partkey, ':', l_suppkey % 10) AS dedupe_key")
    return plain(flags.new_flags(requests, t.table("d_flags")).select("dedupe_key", "property_id", "flag_type", "impact"))


@query("FIL-6_flag_page", "SRT-3", sql="""
    SELECT property_id, dedupe_key, flag_type, CAST(impact AS DOUBLE) AS impact FROM d_flags WHERE status = 'open'
    ORDER BY d_flags.impact DESC NULLS LAST, property_id, dedupe_key LIMIT 1000""")
def flag_page(t):
    return plain(flags.list_flags(t.table("d_flags"), limit=5000).select("property_id", "dedupe_key", "flag_type", "impact"))


@query("SRT-3_open_flags", sql="""
    SELECT property_id, dedupe_key, CAST(impact AS DOUBLE) AS impact FROM d_flags WHERE status = 'open'""")
def open_flags(t):
    return plain(flags.open_flags(t.table("d_flags")).select("property_id", "dedupe_key", "impact"))


# --- changes: a second snapshot with moved, removed, corrected and added entries -------------

AFTER = {
    "d_foreclosure_after": f"""
        SELECT property_id, CASE WHEN property_id % 20 = 0 THEN 'cancelled' WHEN property_id % 20 = 4 THEN 'sold' ELSE stage END AS stage,
          nod_date, nts_date, original_sale_date,
          CASE WHEN property_id % 12 = 0 THEN current_sale_date + 30 ELSE current_sale_date END AS current_sale_date, published_bid,
          postponement_count, CAST(CASE WHEN property_id % 44 = 0 THEN rescission_count + 1 ELSE rescission_count END AS INT) AS rescission_count,
          CASE WHEN property_id % 28 = 0 THEN true ELSE is_active END AS is_active
        FROM ({PROJECTIONS['d_foreclosure']}) x WHERE property_id % 36 <> 0""",
    "d_liens_after": f"""
        SELECT property_id, seq, lien_type, CASE WHEN property_id % 9 = 1 THEN amount + 100 ELSE amount END AS amount,
          CASE WHEN property_id % 9 = 2 THEN 'released' ELSE status END AS status, recording_date
        FROM ({PROJECTIONS['d_liens']}) x WHERE property_id % 9 <> 3
        UNION ALL SELECT property_id, seq || 'b', lien_type, amount, status, recording_date
        FROM ({PROJECTIONS['d_liens']}) y WHERE property_id % 9 = 4""",
    "d_listings_after": f"""
        SELECT property_id, seq, list_date, status, CASE WHEN property_id % 3 = 0 THEN price - 1000 ELSE price END AS price
        FROM ({PROJECTIONS['d_listings']}) x
        UNION ALL SELECT property_id, seq || 'b', list_date + 1, status, price FROM ({PROJECTIONS['d_listings']}) y WHERE property_id % 5 = 0""",
    "d_owners_after": f"""
        SELECT property_id, CASE WHEN property_id % 10 = 0 THEN owner_name || ' Trust' ELSE owner_name END AS owner_name
        FROM ({PROJECTIONS['d_owners']}) x WHERE NOT (property_id % 12 = 0 AND owner_name NOT LIKE 'Brand%')""",
    "d_bankruptcies_after": f"""
        SELECT property_id, seq, chapter, status, filing_date FROM ({PROJECTIONS['d_bankruptcies']}) x
        UNION ALL SELECT property_id, seq || 'b', chapter, status, filing_date FROM ({PROJECTIONS['d_bankruptcies']}) y
        WHERE property_id % 3 = 0""",
    "d_valuations_after": f"""
        SELECT property_id, seq, valuation_type, CASE WHEN property_id % 6 = 0 THEN value + value ELSE value END AS value, confidence,
          is_estimated FROM ({PROJECTIONS['d_valuations']}) x""",
}
for _name, _text in AFTER.items():
    PROJECTIONS[_name] = _text
    STEPS[_name] = _text.format(**{name: name for name in ("part", "orders", "lineitem")})


def _snapshots(t):
    before = t.portfolio()
    after = replace(before, **{name: conform(t.table(f"d_{name}_after"), PORTFOLIO_SCHEMAS[name]) for name in (
        "foreclosure", "liens", "listings", "owners", "bankruptcies", "valuations")})
    return before, after


def _paired_sql(name: str, keys: str) -> str:
    numbered = "SELECT *, row_number() OVER (PARTITION BY property_id, {keys} ORDER BY seq) AS k FROM {table}"
    on = " AND ".join(f"b.{key} IS NOT DISTINCT FROM a.{key}" for key in ("property_id", "k", *keys.split(", ")))
    return (f"({numbered.format(keys=keys, table=f'd_{name}')}) b FULL JOIN "
            f"({numbered.format(keys=keys, table=f'd_{name}_after')}) a ON {on}")


FORECLOSURE_EVENTS = """
    SELECT property_id, kind AS change_type, CASE WHEN kind = 'sale_date_moved' THEN 'foreclosure.current_sale_date' ELSE 'foreclosure.stage' END AS field_path,
      CASE WHEN kind = 'sale_date_moved' THEN CAST(b_date AS VARCHAR) ELSE b_stage END AS old_value,
      CASE WHEN kind = 'sale_date_moved' THEN CAST(a_date AS VARCHAR) ELSE a_stage END AS new_value
    FROM (SELECT property_id, b.stage AS b_stage, a.stage AS a_stage, b.current_sale_date AS b_date, a.current_sale_date AS a_date,
        CASE WHEN NOT coalesce(b.is_active, false) AND coalesce(a.is_active, false) THEN 'new_foreclosure_notice'
             WHEN b.stage IS NULL OR a.stage IS NULL THEN CASE WHEN b.is_active THEN 'sale_cancelled' END
             WHEN a.rescission_count > b.rescission_count OR (a.stage = 'cancelled' AND b.stage <> 'cancelled') THEN 'sale_cancelled'
             WHEN a.stage = 'sold' AND b.stage <> 'sold' THEN 'sale_completed'
             WHEN b.current_sale_date IS DISTINCT FROM a.current_sale_date THEN 'sale_date_moved' END AS kind
      FROM d_foreclosure b FULL JOIN d_foreclosure_after a USING (property_id)) WHERE kind IS NOT NULL"""


@query("CHG-1_foreclosure_changes", sql=FORECLOSURE_EVENTS)
def foreclosure_changes(t):
    return plain(changes.foreclosure_changes(*_snapshots(t)))


LIEN_EVENTS = f"""
    SELECT property_id, change_type, field_path, old_value, new_value FROM (
      SELECT coalesce(b.property_id, a.property_id) AS property_id,
        CASE WHEN b.k IS NULL THEN 'new_lien' WHEN a.k IS NULL THEN 'lien_released'
             WHEN a.status = 'released' AND b.status <> 'released' THEN 'lien_released'
             WHEN b.amount IS DISTINCT FROM a.amount THEN 'lien_amount_corrected' END AS change_type,
        'liens[' || coalesce(b.lien_type, a.lien_type) || ']' || CASE WHEN b.k IS NULL OR a.k IS NULL THEN ''
          WHEN a.status = 'released' AND b.status <> 'released' THEN '.status' ELSE '.amount' END AS field_path,
        CASE WHEN b.k IS NULL THEN NULL WHEN a.k IS NULL THEN CAST(b.amount AS VARCHAR)
             WHEN a.status = 'released' AND b.status <> 'released' THEN b.status ELSE CAST(b.amount AS VARCHAR) END AS old_value,
        CASE WHEN a.k IS NULL THEN NULL WHEN b.k IS NULL THEN CAST(a.amount AS VARCHAR)
             WHEN a.status = 'released' AND b.status <> 'released' THEN a.status ELSE CAST(a.amount AS VARCHAR) END AS new_value
      FROM {_paired_sql('liens', 'lien_type, recording_date')}) WHERE change_type IS NOT NULL"""


@query("CHG-2_lien_changes", "JOI-8", sql=LIEN_EVENTS)
def lien_changes(t):
    return plain(changes.lien_changes(*_snapshots(t)))


LISTING_EVENTS = f"""
    SELECT property_id, change_type, field_path, old_value, new_value FROM (
      SELECT coalesce(b.property_id, a.property_id) AS property_id,
        CASE WHEN b.k IS NULL THEN 'new_listing' WHEN a.price < b.price THEN 'price_cut' END AS change_type,
        'listings[' || CAST(coalesce(b.list_date, a.list_date) AS VARCHAR) || ']' || CASE WHEN b.k IS NULL THEN '' ELSE '.price' END AS field_path,
        CAST(b.price AS VARCHAR) AS old_value, CAST(a.price AS VARCHAR) AS new_value
      FROM {_paired_sql('listings', 'list_date, status')}) WHERE change_type IS NOT NULL"""


@query("CHG-3_listing_changes", sql=LISTING_EVENTS)
def listing_changes(t):
    return plain(changes.listing_changes(*_snapshots(t)))


OWNER_EVENTS = """
    SELECT property_id, b.names AS old_value, a.names AS new_value
    FROM (SELECT property_id, string_agg(DISTINCT owner_name, '; ' ORDER BY owner_name) AS names FROM d_owners GROUP BY 1) b
    JOIN (SELECT property_id, string_agg(DISTINCT owner_name, '; ' ORDER BY owner_name) AS names FROM d_owners_after GROUP BY 1) a
      USING (property_id) WHERE b.names <> a.names"""


@query("CHG-4_ownership_changes", sql=OWNER_EVENTS)
def ownership_changes(t):
    return plain(changes.ownership_changes(*_snapshots(t)).select("property_id", "old_value", "new_value"))


BANKRUPTCY_EVENTS = """
    SELECT property_id, 'bankruptcies[' || chapter || ']' AS field_path, CAST(filing_date AS VARCHAR) AS new_value
    FROM d_bankruptcies WHERE property_id % 3 = 0"""


@query("CHG-5_new_bankruptcies", sql=BANKRUPTCY_EVENTS)
def new_bankruptcies(t):
    return plain(changes.bankruptcy_changes(*_snapshots(t)).select("property_id", "field_path", "new_value"))


VALUE = """SELECT property_id, CAST(sum(value * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS v
    FROM (SELECT property_id, value, confidence AS w FROM {table}) GROUP BY 1"""


@query("CHG-6_value_shifts", "AGG-25", sql=f"""
    SELECT property_id, round(b.v, 2) AS old_value, round(a.v, 2) AS new_value FROM ({VALUE.format(table='d_valuations')}) b
    JOIN ({VALUE.format(table='d_valuations_after')}) a USING (property_id) WHERE abs(a.v - b.v) > 0.10 * abs(b.v)""")
def value_shifts(t):
    return plain(changes.value_changes(*_snapshots(t)).selectExpr(
        "property_id", "round(CAST(old_value AS DOUBLE), 2) AS old_value", "round(CAST(new_value AS DOUBLE), 2) AS new_value"))


# The weighted mean as text in whole millionths, rounded half up at eight places and then at six, as decimal division gives it.
EXACT_VALUE = """SELECT property_id, ((200000000 * wv + w) // (2 * w) + 50) // 100 AS v FROM (
    SELECT property_id, CAST(sum(CAST(value * 100 AS HUGEINT) * CAST(confidence * 10000 AS HUGEINT)) * 100 AS HUGEINT) AS wv,
      CAST(sum(CAST(confidence * 10000 AS HUGEINT)) * 10000 AS HUGEINT) AS w FROM {table} WHERE value IS NOT NULL GROUP BY 1)"""
AS_TEXT = "CAST({v} // 1000000 AS VARCHAR) || '.' || lpad(CAST({v} % 1000000 AS VARCHAR), 6, '0')"


@query("CHG-7_change_events", "SNK-7 CHG-6", sql=f"""
    SELECT property_id, change_type, field_path, old_value, new_value FROM ({FORECLOSURE_EVENTS}) UNION ALL BY NAME
    SELECT property_id, change_type, field_path, old_value, new_value FROM ({LIEN_EVENTS}) UNION ALL BY NAME
    SELECT property_id, change_type, field_path, old_value, new_value FROM ({LISTING_EVENTS}) UNION ALL BY NAME
    SELECT property_id, 'ownership_transfer' AS change_type, 'ownership.owner_names' AS field_path, old_value, new_value FROM ({OWNER_EVENTS}) UNION ALL BY NAME
    SELECT property_id, 'new_bankruptcy' AS change_type, field_path, NULL AS old_value, new_value FROM ({BANKRUPTCY_EVENTS}) UNION ALL BY NAME
    SELECT property_id, 'value_shift' AS change_type, 'valuation.value' AS field_path, {AS_TEXT.format(v='b.v')} AS old_value, {AS_TEXT.format(v='a.v')} AS new_value
    FROM ({EXACT_VALUE.format(table='d_valuations')}) b JOIN ({EXACT_VALUE.format(table='d_valuations_after')}) a USING (property_id)
    WHERE 10 * abs(a.v - b.v) > b.v""")
def change_events(t):
    return plain(changes.detect_changes(*_snapshots(t)))


@query("SET-3_flat_diff", "CHG-7", sql="""
    SELECT property_id, change_type, field_path, old_value, new_value FROM (
      SELECT coalesce(b.property_id, a.property_id) AS property_id, coalesce(b.field, a.field) AS field_path, b.value AS old_value,
        a.value AS new_value, CASE WHEN coalesce(b.field, a.field) LIKE 'foreclosure%' THEN
          CASE WHEN b.value IS NULL THEN 'new_foreclosure_notice' ELSE 'sale_date_moved' END ELSE 'field_changed' END AS change_type
      FROM (SELECT property_id, 'foreclosure.current_sale_date' AS field, CAST(current_sale_date AS VARCHAR) AS value FROM d_foreclosure
            UNION ALL SELECT property_id, 'stage', stage FROM d_foreclosure) b
      FULL JOIN (SELECT property_id, 'foreclosure.current_sale_date' AS field, CAST(current_sale_date AS VARCHAR) AS value FROM d_foreclosure_after
            UNION ALL SELECT property_id, 'stage', stage FROM d_foreclosure_after) a
        ON a.property_id = b.property_id AND a.field = b.field) WHERE old_value IS DISTINCT FROM new_value""")
def flat_diff(t):
    def fields(df):
        return df.selectExpr("property_id", """inline(array(
            struct('foreclosure.current_sale_date' AS field, CAST(current_sale_date AS STRING) AS value),
            struct('stage' AS field, stage AS value)))""")

    before, after = _snapshots(t)
    return plain(changes.diff_records(fields(before.foreclosure), fields(after.foreclosure)))


@query("FLG-12_flag_resolutions", sql="""
    SELECT flag_no AS flag_id, CASE WHEN status = 'open' AND flag_no % 4 <> 3 THEN 'resolved' ELSE status END AS status,
      CASE WHEN status = 'open' AND flag_no % 4 <> 3 THEN
        CASE flag_no % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'replace' END END AS resolution
    FROM (SELECT flag_no, min(status) AS status FROM d_flags GROUP BY 1)""")
def flag_resolutions(t):
    table = t.table("d_flags").groupBy(F.col("flag_no").alias("flag_id")).agg(
        F.min("property_id").alias("property_id"), F.min("flag_type").alias("flag_type"), F.min("status").alias("status"))
    table = table.withColumn("fact_ids", F.array(F.concat(F.lit("f"), F.col("flag_id"))))
    decisions = table.selectExpr(
        "flag_id", "CASE flag_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'replace' ELSE 'unknown' END AS action",
        "'attributes.sqft' AS field_path", "'1500' AS value", "'checked' AS note", "'u1' AS user_id",
        "TIMESTAMP'2002-01-01 00:00:00' AS decided_at")
    facts = table.selectExpr("fact_ids[0] AS fact_id", "property_id", "'attributes.sqft' AS field_path", "true AS is_active")
    resolutions = table.selectExpr("fact_ids[0] AS winning_fact_id", "property_id", "'auto' AS verification_state")
    out = flags.resolve_flags(table, decisions, facts, resolutions)
    return plain(out["flags"].select("flag_id", "status", "resolution"))
