"""Comparisons, comp sets and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelscope.functions.text import numbers_in
from parcelscope.operators import analyst, calibration
from parcelscope.operators.scoring import DEFAULT_CONFIG
from parcelscope.plans.catalog import plain, query, step
from parcelscope.plans.catalog.lists import computed
from parcelscope.session import spread


def _pairs(t):
    """Every property against the next one."""
    return spread(t.source("part").selectExpr("p_partkey AS a_id", "p_partkey + 1 AS b_id"), "a_id")


TERM_COLUMNS = {
    "fos_profit_norm": "n_profit", "fos_roi_norm": "n_roi", "fos_equity_pct_norm": "n_equity", "fos_discount_to_value_norm": "n_discount",
    "fos_margin_of_safety_norm": "n_margin", "distress_nts": "t_nts", "distress_nod": "t_nod", "distress_prior_foreclosure": "t_prior",
    "distress_bankruptcy_active": "t_bk", "distress_bankruptcy_prior": "t_bk_prior", "distress_repeat_filings": "t_repeat",
    "distress_tax_lien_attached": "t_tax", "distress_tax_lien_owner_only": "t_tax_owner", "distress_other_involuntary_liens": "t_other",
    "distress_taxes_delinquent_2yr": "t_taxes", "distress_absentee": "t_absentee", "distress_owned_over_15yr": "t_long",
    "distress_listing_expired": "t_listing",
    "distress_high_equity_bonus": "CASE WHEN equity_pct >= 0.50 AND plain_distress > 0 THEN 5 END",
}
CELLS = ", ".join(f"{{'name': '{name}', 'points': CAST({column} AS DOUBLE)}}" for name, column in TERM_COLUMNS.items())
step("o_terms", f"SELECT property_id, unnest([{CELLS}], recursive := true) FROM o_score_parts")
step("o_term_deltas", """
    SELECT a.property_id AS a_id, a.property_id + 1 AS b_id, a.name, round(coalesce(a.points, 0) - coalesce(b.points, 0), 6) AS point_delta
    FROM o_terms a JOIN o_terms b ON b.property_id = a.property_id + 1 AND a.name = b.name""")
MEASURED = "name LIKE 'fos_%' OR name LIKE 'distress_%'"


@query("ANL-1_term_deltas", "JOI-12", sql="SELECT a_id, b_id, name, point_delta FROM o_term_deltas WHERE point_delta <> 0")
def term_deltas(t):
    inside = _pairs(t).join(t.source("part").select(F.col("p_partkey").alias("b_id")), "b_id", "left_semi")
    rows = analyst.term_deltas(inside, computed(t).scores).where("point_delta <> 0").where(MEASURED)
    return plain(rows.selectExpr("a_id", "b_id", "name", "round(CAST(point_delta AS DOUBLE), 6) AS point_delta"))


@query("WIN-11_top_drivers", "ANL-1")
def top_drivers(t):
    return plain(analyst.top_drivers(_pairs(t), computed(t).scores).select("a_id", "b_id", "place", "name", "point_delta"))


@query("ANL-1_pillar_deltas", sql="""
    SELECT a.property_id AS a_id, b.property_id AS b_id, CAST(a.overall - b.overall AS DOUBLE) AS overall_delta, CAST(a.fos - b.fos AS DOUBLE) AS fos_delta,
      round(CAST(a.distress AS DOUBLE) - CAST(b.distress AS DOUBLE), 4) AS distress_delta, round(CAST(b.risk AS DOUBLE) - CAST(a.risk AS DOUBLE), 4) AS risk_delta
    FROM o_score a JOIN o_score b ON b.property_id = a.property_id + 1""")
def pillar_deltas(t):
    return plain(analyst.pillar_deltas(_pairs(t), computed(t).scores).selectExpr(
        "a_id", "b_id", "overall_delta", "fos_delta", "round(CAST(distress_delta AS DOUBLE), 4) AS distress_delta",
        "round(CAST(risk_delta AS DOUBLE), 4) AS risk_delta"))


@query("ANL-2_explanations", "STR-19")
def explanations(t):
    return plain(analyst.explanations(_pairs(t), computed(t).scores))


@query("STR-18_numbers_in_text", sql="""
    SELECT doc_id, len(regexp_extract_all(text, '[-+]?\\$?\\d[\\d,]*(?:\\.\\d+)?%?')) AS numbers FROM documents""")
def numbers_in_text(t):
    numbers = F.when(F.col("text").isNotNull(), F.size(numbers_in(F.col("text"))))
    return plain(t.source("documents").select("doc_id", numbers.cast("bigint").alias("numbers")))


@query("ANL-3_number_check", "JSN-1 SET-6", sql="""
    SELECT id, CAST(CASE WHEN n = price THEN 1 ELSE 2 END AS BIGINT) AS numbers, id % 5 <> 0 OR n = price OR n = round_even(price, 1) AS is_valid
    FROM (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(16,2)) AS price,
            round_even(CAST(o_totalprice AS DECIMAL(16,2)), 0) + CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0 END AS n FROM orders)""")
def number_check(t):
    orders = t.source("orders").selectExpr("o_orderkey AS id", "CAST(o_totalprice AS DECIMAL(16,2)) AS price")
    texts = orders.selectExpr("id", """concat('Worth $', format_number(price, 2), ' or ',
        CAST(CAST(bround(price, 0) + CASE WHEN id % 5 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(16,1)) AS STRING), '.') AS text""")
    return plain(analyst.numbers_allowed(texts, orders.select("id", F.col("price").alias("number"))))


@query("ANL-4_comp_sets", "WIN-12", sql="""
    SELECT set_id, metric, property_id, CAST(value AS DOUBLE) AS value,
      coalesce(count(value) OVER w >= 2 AND value = CASE WHEN metric IN ('confirmed_debt', 'risk') THEN min(value) OVER w ELSE max(value) OVER w END, false) AS is_winner
    FROM (SELECT property_id // 4 AS set_id, property_id, unnest([
        {'metric': 'value', 'value': CAST(v AS DOUBLE)}, {'metric': 'confirmed_debt', 'value': CAST(confirmed AS DOUBLE)},
        {'metric': 'adjusted_equity', 'value': CAST(adjusted AS DOUBLE)}, {'metric': 'overall', 'value': CAST(overall AS DOUBLE)},
        {'metric': 'fos', 'value': CAST(fos AS DOUBLE)}, {'metric': 'distress', 'value': round(CAST(distress AS DOUBLE), 4)},
        {'metric': 'data_confidence', 'value': CAST(dcs AS DOUBLE)}, {'metric': 'risk', 'value': round(CAST(risk AS DOUBLE), 4)},
        {'metric': 'mao', 'value': CAST(best_mao AS DOUBLE)}, {'metric': 'profit', 'value': CAST(best_profit AS DOUBLE)},
        {'metric': 'roi', 'value': CAST(best_roi AS DOUBLE)}], recursive := true)
      FROM (SELECT s.*, b.best_mao FROM o_score s LEFT JOIN o_best b USING (property_id))) WINDOW w AS (PARTITION BY set_id, metric)""")
def comp_sets(t):
    r = computed(t)
    sets = t.source("part").selectExpr("CAST(floor(p_partkey / 4) AS BIGINT) AS set_id", "p_partkey AS property_id")
    rows = analyst.comp_sets(sets, r.underwriting, r.scores, r.strategies("status", "mao", "profit", "roi"))
    return plain(rows.where("metric NOT IN ('best_strategy', 'key_risks', 'refused')").drop("text"))


@query("AGG-19_repair_costs", "CAL-1", sql="""
    SELECT condition, count(*) AS sample_size, CAST(sum(predicted_repairs) AS DOUBLE) AS predicted_total, CAST(sum(actual_repairs) AS DOUBLE) AS actual_total,
      round(CAST(sum(actual_repairs) AS DOUBLE) / CAST(sum(predicted_repairs) AS DOUBLE), 6) AS correction_factor,
      CAST(round_even(CASE condition WHEN 'cosmetic' THEN 18 WHEN 'moderate' THEN 42 WHEN 'heavy' THEN 78 WHEN 'gut' THEN 135 END
        * CAST(sum(actual_repairs) AS DOUBLE) / CAST(sum(predicted_repairs) AS DOUBLE), 2) AS DOUBLE) AS suggested_psf
    FROM d_deals WHERE condition IS NOT NULL AND actual_repairs IS NOT NULL GROUP BY 1""")
def repair_costs(t):
    return plain(calibration.repair_costs(t.deals()).selectExpr(
        "condition", "sample_size", "predicted_total", "actual_total", "round(CAST(correction_factor AS DOUBLE), 6) AS correction_factor", "suggested_psf"))


step("o_errors", """
    SELECT kind, (CAST(p AS DOUBLE) - CAST(sale_price AS DOUBLE)) / CAST(sale_price AS DOUBLE) AS e FROM (
      SELECT 'avm' AS kind, predicted_avm AS p, sale_price FROM d_deals UNION ALL SELECT 'comp', predicted_comp, sale_price FROM d_deals
      UNION ALL SELECT 'assessed', predicted_assessed, sale_price FROM d_deals) WHERE p IS NOT NULL AND sale_price > 0""")


@query("AGG-20_valuation_accuracy", "CAL-2", sql="""
    SELECT kind AS valuation_type, n AS sample_size, round(signed, 6) AS mean_signed_error, round(absolute, 6) AS mean_abs_error,
      round(w + CASE WHEN w = max(w) OVER () THEN 1 - sum(w) OVER () ELSE 0 END, 4) AS suggested_weight
    FROM (SELECT *, round_even((1 / absolute) / sum(1 / absolute) OVER (), 4) AS w
          FROM (SELECT kind, count(*) AS n, avg(e) AS signed, greatest(avg(abs(e)), 0.0001) AS absolute FROM o_errors GROUP BY 1))""")
def valuation_accuracy(t):
    return plain(calibration.valuation_accuracy(t.deals()).selectExpr(
        "valuation_type", "sample_size", "round(CAST(mean_signed_error AS DOUBLE), 6) AS mean_signed_error",
        "round(CAST(mean_abs_error AS DOUBLE), 6) AS mean_abs_error", "suggested_weight"))


@query("AGG-21_holding_period", "CAL-3", sql="""
    SELECT count(*) AS sample_size, round(avg(predicted_holding_days), 4) AS mean_predicted_days, round(avg(actual_holding_days), 4) AS mean_actual_days,
      round(avg(actual_holding_days - predicted_holding_days), 4) AS mean_bias_days,
      CAST(greatest(0, trunc(60 + avg(actual_holding_days - predicted_holding_days))) AS BIGINT) AS suggested_market_days
    FROM d_deals WHERE predicted_holding_days IS NOT NULL""")
def holding_period(t):
    return plain(calibration.holding_period(t.deals()).selectExpr("sample_size", *[
        f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("mean_predicted_days", "mean_actual_days", "mean_bias_days")], "suggested_market_days"))


@query("AGG-22_gut_correlation", "CAL-4 WIN-14", sql="""
    SELECT count(*) AS sample_size, round(corr(x, y), 6) AS coefficient FROM (
      SELECT rank() OVER (ORDER BY gut_rating) + (count(*) OVER (PARTITION BY gut_rating) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY overall_score) + (count(*) OVER (PARTITION BY overall_score) - 1) / 2.0 AS y
      FROM d_deals WHERE gut_rating IS NOT NULL)""")
def gut_correlation(t):
    return plain(calibration.gut_correlation(t.deals()).selectExpr("sample_size", "round(coefficient, 6) AS coefficient"))


step("o_profits", """
    SELECT *, CASE WHEN outcome <> 'dead' THEN sale_price - purchase_price - actual_repairs - actual_costs END AS profit FROM d_deals""")


@query("CAL-8_realized_profit", sql="""
    SELECT deal_id, CAST(profit AS DOUBLE) AS realized_profit, coalesce(profit > 0, false) AS is_hit FROM o_profits""")
def realized_profit(t):
    return plain(calibration.realized(t.deals()).select("deal_id", "realized_profit", "is_hit"))


@query("AGG-23_score_bands", "CAL-5", sql="""
    SELECT low, high, count(deal_id) AS sample_size, count(*) FILTER (WHERE profit > 0) AS hits,
      round(CAST(count(*) FILTER (WHERE profit > 0) AS DOUBLE) / nullif(count(deal_id), 0), 6) AS hit_rate,
      round(avg(CAST(profit AS DOUBLE)), 2) AS mean_realized_profit
    FROM (VALUES (0, 45), (45, 60), (60, 70), (70, 85), (85, 101)) b(low, high) LEFT JOIN o_profits ON overall_score >= low AND overall_score < high
    GROUP BY 1, 2""")
def score_bands(t):
    return plain(calibration.score_bands(t.deals()).selectExpr(
        "CAST(low AS BIGINT) AS low", "CAST(high AS BIGINT) AS high", "sample_size", "hits", "hit_rate", "round(CAST(mean_realized_profit AS DOUBLE), 2) AS mean_realized_profit"))


step("o_pillars", """
    SELECT pillar, avg(s) FILTER (WHERE profit > 0) AS hits_mean, avg(s) FILTER (WHERE profit <= 0) AS misses_mean FROM (
      SELECT profit, unnest([{'pillar': 'fos', 's': CAST(fos AS DOUBLE)}, {'pillar': 'distress', 's': CAST(distress AS DOUBLE)},
        {'pillar': 'dcs', 's': CAST(dcs AS DOUBLE)}, {'pillar': 'risk', 's': CAST(risk AS DOUBLE)}], recursive := true)
      FROM o_profits WHERE profit IS NOT NULL) GROUP BY 1""")


@query("AGG-24_pillar_separation", "CAL-5", sql="""
    SELECT pillar, round(hits_mean, 5) AS hits_mean, round(misses_mean, 5) AS misses_mean,
      round((hits_mean - misses_mean) * CASE pillar WHEN 'risk' THEN -1 ELSE 1 END, 5) AS separation FROM o_pillars""")
def pillar_separation(t):
    return plain(calibration.pillar_separation(t.deals()).selectExpr("pillar", *[
        f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in ("hits_mean", "misses_mean", "separation")]))


@query("AGG-24_weight_suggestion", "CAL-5", sql="""
    SELECT p AS pillar, w AS current_weight, CASE WHEN best.s > 0 AND worst.s <= 0 THEN round(w + CASE p WHEN best.pillar THEN 0.05 WHEN worst.pillar THEN -0.05 ELSE 0 END, 4) END AS suggested_weight
    FROM (VALUES ('fos', 0.5::DOUBLE), ('distress', 0.2), ('dcs', 0.2), ('risk', 0.25)) v(p, w),
      (SELECT pillar, (hits_mean - misses_mean) * CASE pillar WHEN 'risk' THEN -1 ELSE 1 END AS s FROM o_pillars ORDER BY s DESC LIMIT 1) best,
      (SELECT pillar, (hits_mean - misses_mean) * CASE pillar WHEN 'risk' THEN -1 ELSE 1 END AS s FROM o_pillars ORDER BY s LIMIT 1) worst""")
def weight_suggestion(t):
    return plain(calibration.weight_suggestion(t.deals(), DEFAULT_CONFIG["weights"]["overall"]).drop("sample_size"))


@query("CAL-6_suggestions", "CAL-7")
def suggestions(t):
    return plain(calibration.suggestions(t.deals()))
