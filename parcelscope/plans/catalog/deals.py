"""Underwriting, strategies, offers and scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parcelscope.functions.lookups import FIRST_RATE_YEAR, LAST_RATE_YEAR, YEARLY_MORTGAGE_RATE
from parcelscope.operators import scoring, strategies, underwriting
from parcelscope.operators.assumptions import DEFAULT_SET, Assumptions, variant
from parcelscope.plans.catalog import plain, query, step
from parcelscope.plans.driver_tables import AS_OF

DAY = date.fromisoformat(AS_OF)
CAUTIOUS = variant(DEFAULT_SET, "cautious", "10000000-0000-0000-0000-000000000003",
                   repairs__low_multiplier="0.65", repairs__high_multiplier="1.6",
                   attachment_probability={"owner_named_only": "0.5", "unknown": "0.65"},
                   resale__commission_pct="0.06")


def money(x: str) -> str:
    return f"ROUND(CAST({x} AS DECIMAL(30,10)), 2)"


def ratio(x: str) -> str:
    return f"ROUND(CAST({x} AS DECIMAL(30,12)), 6)"


def share(a: str, b: str) -> str:
    return ratio(f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)")


def months(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


RATES = ", ".join(f"({year}, {rate})" for year, rate in YEARLY_MORTGAGE_RATE.items())

step("o_rates", f"SELECT * FROM (VALUES {RATES}) AS r(rate_year, base_rate)")
step("o_ref", "SELECT property_id, newest_report_date AS ref, sqft AS subject FROM d_core")
step("o_comps", """
    SELECT c.property_id, count(*) AS n, count(distance) AS n_distance, sum(distance) AS distance_sum,
      count(*) FILTER (WHERE sale_date IS NOT NULL AND ref IS NOT NULL) AS n_dated,
      sum(greatest(0, ref - sale_date)) FILTER (WHERE sale_date IS NOT NULL AND ref IS NOT NULL) AS days_sum,
      count(*) FILTER (WHERE sqft <> 0 AND subject <> 0) AS n_sized,
      sum(abs(sqft - subject)) FILTER (WHERE sqft <> 0 AND subject <> 0) AS delta_sum, max(subject) AS subject,
      min(price) AS lo, max(price) AS hi
    FROM d_comparables c JOIN o_ref USING (property_id) WHERE included AND price IS NOT NULL GROUP BY 1""")
step("o_comp_factor", """
    SELECT property_id, lo, hi, n, greatest(0.3, least(1.0,
      CASE WHEN n >= 5 THEN 1.0 WHEN n >= 3 THEN 0.85 ELSE 0.7 END
      * CASE WHEN n_distance = 0 OR distance_sum <= n_distance THEN 1.0
             WHEN distance_sum <= 2 * n_distance THEN 0.9 ELSE 0.8 END
      * CASE WHEN n_dated = 0 OR days_sum <= 180 * n_dated THEN 1.0
             WHEN days_sum <= 365 * n_dated THEN 0.9 ELSE 0.8 END
      * CASE WHEN n_sized = 0 OR delta_sum <= 0.1 * subject * n_sized THEN 1.0
             WHEN delta_sum <= 0.2 * subject * n_sized THEN 0.9 ELSE 0.8 END)) AS factor
    FROM o_comps""")
step("o_weights", f"""
    SELECT v.property_id, v.seq, v.valuation_type, v.value, v.value_low, v.value_high, f.lo, f.hi,
      CASE WHEN valuation_type = 'avm' THEN
             {ratio("0.30 * coalesce(reported_confidence, 1) * CAST(pow(0.5, coalesce(greatest(0, ref - as_of), 0) / 90.0) AS DOUBLE)")}
           WHEN valuation_type = 'comp' THEN ROUND(CAST(coalesce(factor, 1) AS DECIMAL(12,8)), 6)
           ELSE 0.10 END AS weight
    FROM d_valuations v JOIN o_ref USING (property_id) LEFT JOIN o_comp_factor f USING (property_id)""")
step("o_value", f"""
    SELECT property_id, count(*) AS candidates,
      {money('CAST(sum(weight * value) AS DOUBLE) / CAST(sum(weight) AS DOUBLE)')} AS v,
      least(min(CASE WHEN valuation_type = 'comp' THEN value_low END), max(lo)) AS range_low,
      greatest(max(CASE WHEN valuation_type = 'comp' THEN value_high END), max(hi)) AS range_high
    FROM o_weights GROUP BY 1""")
step("o_blend", f"""
    SELECT *, {money('greatest(CAST(v AS DOUBLE) * (1 - CAST(dispersion AS DOUBLE)), coalesce(range_low, 0))')} AS v_low,
      {money('least(CAST(v AS DOUBLE) * (1 + CAST(dispersion AS DOUBLE)), coalesce(range_high, 1e14))')} AS v_high
    FROM (SELECT b.property_id, b.candidates, b.v, b.range_low, b.range_high,
            CASE WHEN b.candidates = 1 THEN 0.15 ELSE greatest(0.04, least(0.30, {ratio(
              '''sqrt(sum(CAST(w.weight AS DOUBLE) * pow(CAST(w.value AS DOUBLE) - CAST(b.v AS DOUBLE), 2))
                 / sum(CAST(w.weight AS DOUBLE))) / CAST(b.v AS DOUBLE)''')})) END AS dispersion
          FROM o_value b JOIN o_weights w USING (property_id) GROUP BY 1, 2, 3, 4, 5)""")
step("o_open", """
    SELECT *, CASE WHEN lower(position) = 'first' THEN '1' WHEN lower(position) = '2nd' THEN '2' ELSE position END AS pos
    FROM d_mortgages""")
step("o_bids", "SELECT property_id, published_bid AS bid FROM d_foreclosure WHERE is_active AND published_bid IS NOT NULL")
step("o_owed", f"""
    SELECT *, CAST(coalesce(rate, greatest(base_rate + CASE WHEN pos = 'HELOC' THEN 0.02 ELSE 0 END, 0)) AS DOUBLE) / 12 AS r,
      coalesce(term_months, 360) AS term, {months('origination_date', 'ref')} AS paid
    FROM (SELECT * FROM o_open WHERE is_open
          QUALIFY row_number() OVER (PARTITION BY property_id, pos ORDER BY coalesce(balance, 0) DESC, seq) = 1) c
    JOIN o_ref USING (property_id) LEFT JOIN o_bids USING (property_id)
    JOIN o_rates ON rate_year = greatest({FIRST_RATE_YEAR}, least({LAST_RATE_YEAR}, year(origination_date)))""")
step("o_positions", f"""
    SELECT property_id, pos, original_amount, bid, balance, balance_is_estimated,
      CASE WHEN ref IS NULL THEN NULL WHEN paid <= 0 THEN original_amount WHEN paid >= term THEN 0
           ELSE {money('CAST(original_amount AS DOUBLE) * (pow(1 + r, term) - pow(1 + r, paid)) / (pow(1 + r, term) - 1)')}
      END AS derived FROM o_owed""")
step("o_balances", """
    SELECT property_id, pos, original_amount, bid,
      CASE WHEN pos = '1' THEN coalesce(bid, balance, derived) ELSE coalesce(balance, derived) END AS amount,
      CASE WHEN balance IS NULL AND derived IS NOT NULL THEN 'amortization_v1' ELSE 'recorded' END AS basis,
      CASE WHEN balance IS NOT NULL THEN balance_is_estimated ELSE derived IS NOT NULL END AS is_estimated
    FROM o_positions""")


def liability_sql(owner: str, unknown: str) -> str:
    chance = f"CASE attachment_basis WHEN 'owner_named_only' THEN {owner} WHEN 'unknown' THEN {unknown} ELSE 1 END"
    median = "CASE lien_type WHEN 'hoa' THEN 4500 WHEN 'mechanics' THEN 12000 WHEN 'judgment' THEN 18000 ELSE 0 END"
    return f"""
    SELECT property_id, 'mortgage:' || pos AS label, amount, basis, is_estimated, 'confirmed' AS bucket,
      CAST(0 AS DECIMAL(16,2)) AS weighted, CAST(0 AS DECIMAL(16,2)) AS weighted_in_offer
    FROM o_balances WHERE amount IS NOT NULL
    UNION ALL SELECT property_id, 'mortgage:' || pos || ':undrawn', original_amount - amount, 'undrawn_heloc_capacity',
      true, 'potential', original_amount - amount, 0 FROM o_balances WHERE pos = 'HELOC' AND original_amount > amount
    UNION ALL SELECT property_id, 'foreclosure:published_bid', bid, 'published_bid', false, 'confirmed', 0, 0 FROM o_bids
      WHERE property_id NOT IN (SELECT property_id FROM o_open WHERE is_open AND pos = '1')
    UNION ALL SELECT property_id, 'delinquent_taxes', delinquent_amount, 'recorded', false, 'confirmed', 0, 0
      FROM d_core WHERE delinquent_amount IS NOT NULL
    UNION ALL SELECT property_id, 'hoa_arrears', hoa_arrears, 'recorded', false, 'confirmed', 0, 0
      FROM d_core WHERE hoa_arrears IS NOT NULL
    UNION ALL SELECT property_id, lien_type, owed, attachment_basis, est,
      CASE WHEN potential THEN 'potential' ELSE 'confirmed' END, CASE WHEN potential THEN w ELSE 0 END,
      CASE WHEN attachment_basis = 'recorded_against_property' THEN 0 ELSE w END
    FROM (SELECT *, coalesce(amount, {median}) AS owed, amount IS NULL OR amount_is_estimated AS est,
            ROUND(coalesce(amount, {median}) * {chance}, 2) AS w,
            attachment_basis <> 'recorded_against_property' OR (amount IS NULL AND {median} <> 0) AS potential
          FROM d_liens WHERE status NOT IN ('released', 'satisfied'))"""


step("o_liability_rows", liability_sql("0.35", "0.50"))
step("o_liability_rows_cautious", liability_sql("0.5", "0.65"))
BUCKETS = """
    SELECT property_id, sum(amount) FILTER (WHERE bucket = 'confirmed') AS confirmed,
      sum(amount) FILTER (WHERE bucket = 'potential') AS potential, sum(weighted) AS weighted,
      sum(weighted_in_offer) AS weighted_offer, bool_or(label LIKE 'mortgage:%') AS has_mortgage
    FROM {rows} GROUP BY 1"""
step("o_buckets", BUCKETS.format(rows="o_liability_rows"))
step("o_buckets_cautious", BUCKETS.format(rows="o_liability_rows_cautious"))


def wide_sql(buckets: str) -> str:
    return f"""
    SELECT k.*, b.candidates, b.v, b.v_low, b.v_high, b.dispersion, b.range_low, b.range_high,
      coalesce(confirmed, 0) AS confirmed, coalesce(potential, 0) AS potential, coalesce(weighted, 0) AS weighted,
      coalesce(weighted_offer, 0) AS weighted_offer, coalesce(has_mortgage, false) AS has_mortgage,
      ROUND(sqft * CASE coalesce(condition, 'moderate') WHEN 'cosmetic' THEN 18 WHEN 'heavy' THEN 78 WHEN 'gut' THEN 135
            ELSE 42 END, 2) AS repairs_base,
      2 + 2 + CASE coalesce(condition, 'moderate') WHEN 'cosmetic' THEN 2 WHEN 'heavy' THEN 6 WHEN 'gut' THEN 9
            ELSE 4 END AS months_base
    FROM d_core k LEFT JOIN o_blend b USING (property_id) LEFT JOIN {buckets} USING (property_id)"""


def underwriting_sql(wide: str, low: str, high: str, resale: str) -> str:
    monthly = money(f"CAST(annual_taxes + value * 0.0085 AS DOUBLE) / 12 + 180 + coalesce(hoa_monthly_dues, 0)")
    return f"""
    SELECT *, value - confirmed AS gross, value - confirmed - used AS adjusted,
      {money(f'value * (1 - {resale}) - confirmed - used - holding')} AS net, {share('value - confirmed', 'value')} AS equity_pct
    FROM (SELECT *, ROUND(monthly * months, 2) AS holding, ROUND(value * 0.025 + 3600, 2) AS acquisition,
            ROUND(value * {resale}, 2) AS resale, CASE WHEN value IS NOT NULL THEN coalesce(repair, 0) END AS repairs,
            value + repair AS arv
          FROM (SELECT *, ROUND(months_base * factor, 4) AS months, {monthly} AS monthly
                FROM (SELECT *, unnest([
                        {{'scenario': 'conservative', 'value': v_low, 'repair': ROUND(repairs_base * {high}, 2),
                          'factor': 1.5, 'used': potential}},
                        {{'scenario': 'expected', 'value': v, 'repair': repairs_base, 'factor': 1.0, 'used': weighted}},
                        {{'scenario': 'optimistic', 'value': v_high, 'repair': ROUND(repairs_base * {low}, 2),
                          'factor': 0.75, 'used': 0}}], recursive := true)
                      FROM {wide})))"""


step("o_wide", wide_sql("o_buckets"))
step("o_wide_cautious", wide_sql("o_buckets_cautious"))
step("o_uw", underwriting_sql("o_wide", "0.75", "1.4", "0.0725"))
step("o_uw_cautious", underwriting_sql("o_wide_cautious", "0.65", "1.6", "0.0825"))


@query("UWR-1_candidate_weights", "AGG-14 MTH-2", sql="""
    SELECT property_id, valuation_type, CAST(value AS DOUBLE) AS value, CAST(weight AS DOUBLE) AS weight FROM o_weights""")
def candidate_weights(t):
    return plain(underwriting.candidate_weights(t.portfolio(), Assumptions())
                 .select("property_id", "valuation_type", "value", "weight"))


@query("UWR-2_valuation_blend", "AGG-12 AGG-13", sql="""
    SELECT property_id, candidates, CAST(v AS DOUBLE) AS v_expected, CAST(dispersion AS DOUBLE) AS dispersion,
      CAST(v_low AS DOUBLE) AS v_low, CAST(v_high AS DOUBLE) AS v_high, CAST(range_low AS DOUBLE) AS comp_range_low,
      CAST(range_high AS DOUBLE) AS comp_range_high FROM o_blend""")
def valuation_blend(t):
    return plain(underwriting.valuation_blend(t.portfolio(), Assumptions()).drop("weight_sum"))


@query("UWR-3_position_balances", "AGG-16 MTH-5 JOI-16 UWR-4", sql="""
    SELECT property_id, pos AS position, CAST(amount AS DOUBLE) AS amount, basis, is_estimated FROM o_balances""")
def position_balances(t):
    return plain(underwriting.position_balances(t.portfolio())
                 .select("property_id", "position", "amount", "basis", "is_estimated"))


@query("UWR-6_liability_rows", "UWR-4 UWR-5 UWR-7", sql="""
    SELECT property_id, label, CAST(amount AS DOUBLE) AS amount, basis, is_estimated, bucket,
      CAST(weighted AS DOUBLE) AS weighted, CAST(weighted_in_offer AS DOUBLE) AS weighted_in_offer FROM o_liability_rows""")
def liability_rows(t):
    return plain(underwriting.liability_rows(t.portfolio(), Assumptions()))


@query("AGG-15_liability_buckets", "UWR-6", sql="""
    SELECT property_id, CAST(coalesce(confirmed, 0) AS DOUBLE) AS confirmed, CAST(coalesce(potential, 0) AS DOUBLE) AS potential,
      CAST(weighted AS DOUBLE) AS potential_weighted, CAST(weighted_offer AS DOUBLE) AS potential_weighted_offer,
      has_mortgage AS has_mortgage_entry FROM o_buckets""")
def liability_buckets(t):
    return plain(underwriting.liability_buckets(t.portfolio(), Assumptions()))


@query("UWR-11_underwriting", "UWR-8 UWR-9 UWR-10 UWR-12 UWR-13 JOI-14 JOI-17 JOI-18", sql="""
    SELECT property_id, scenario, CASE WHEN candidates > 0 THEN 'ok' ELSE 'insufficient_data' END AS status,
      CAST(value AS DOUBLE) AS value, CAST(arv AS DOUBLE) AS arv, CAST(acquisition AS DOUBLE) AS acquisition,
      CAST(repairs AS DOUBLE) AS repairs, CAST(holding AS DOUBLE) AS holding, CAST(resale AS DOUBLE) AS resale,
      CAST(months AS DOUBLE) AS months, CAST(confirmed AS DOUBLE) AS confirmed,
      CAST(confirmed + potential AS DOUBLE) AS maximum, CAST(gross AS DOUBLE) AS gross_equity,
      CAST(adjusted AS DOUBLE) AS adjusted_equity, CAST(net AS DOUBLE) AS net_realizable,
      CAST(equity_pct AS DOUBLE) AS equity_pct,
      property_id IN (SELECT property_id FROM d_mortgages UNION SELECT property_id FROM d_liens) AS debt_data_present,
      CAST(CASE WHEN candidates IS NULL THEN 0 WHEN candidates = 1 THEN least(mean_extraction_confidence, 0.5)
           ELSE mean_extraction_confidence END AS DOUBLE) AS valuation_confidence
    FROM o_uw""")
def underwrite(t):
    return plain(underwriting.underwrite(t.portfolio(), Assumptions()).select(
        "property_id", "scenario", "status", "value", "arv", "acquisition", "repairs", "holding", "resale", "months",
        "confirmed", "maximum", "gross_equity", "adjusted_equity", "net_realizable", "equity_pct", "debt_data_present",
        "valuation_confidence"))


@query("UWR-14_finance_flags", sql=f"""
    SELECT property_id, 'bid_mismatch' AS flag_type, CAST(abs(bid - balance) AS DOUBLE) AS impact
    FROM (SELECT m.property_id, arg_min(own, seq) AS balance, any_value(bid) AS bid
          FROM (SELECT o.property_id, o.seq, b.bid, coalesce(o.balance,
                  CASE WHEN ref IS NULL THEN NULL WHEN {months('origination_date', 'ref')} <= 0 THEN original_amount
                       WHEN {months('origination_date', 'ref')} >= coalesce(term_months, 360) THEN 0
                       ELSE {money('''CAST(original_amount AS DOUBLE)
                         * (pow(1 + coalesce(CAST(rate AS DOUBLE), CAST(base_rate AS DOUBLE)) / 12, coalesce(term_months, 360))
                            - pow(1 + coalesce(CAST(rate AS DOUBLE), CAST(base_rate AS DOUBLE)) / 12, '''
                            + months('origination_date', 'ref') + '''))
                         / (pow(1 + coalesce(CAST(rate AS DOUBLE), CAST(base_rate AS DOUBLE)) / 12, coalesce(term_months, 360)) - 1)''')}
                  END) AS own
                FROM o_open o JOIN o_ref USING (property_id) JOIN o_bids b USING (property_id)
                JOIN o_rates ON rate_year = year(origination_date) WHERE is_open AND pos = '1') m
          WHERE own IS NOT NULL GROUP BY 1)
    WHERE bid <> 0 AND abs(bid - balance) > 0.20 * bid
    UNION ALL SELECT property_id, 'missing_lien_amount', NULL FROM d_liens
      WHERE amount IS NULL AND status NOT IN ('released', 'satisfied')""")
def finance_flags(t):
    return plain(underwriting.finance_flags(t.portfolio()).drop("dedupe_key"))


@query("UWR-15_what_if", sql="""
    SELECT a.property_id, a.scenario, CAST(a.adjusted AS DOUBLE) AS adjusted_equity_now,
      CAST(b.adjusted AS DOUBLE) AS adjusted_equity_then, CAST(a.net AS DOUBLE) AS net_realizable_now,
      CAST(b.net AS DOUBLE) AS net_realizable_then, CAST(a.arv AS DOUBLE) AS arv_now, CAST(b.arv AS DOUBLE) AS arv_then,
      CAST(a.repairs AS DOUBLE) AS repairs_now, CAST(b.repairs AS DOUBLE) AS repairs_then,
      CAST(b.adjusted - a.adjusted AS DOUBLE) AS adjusted_equity_change
    FROM o_uw a JOIN o_uw_cautious b USING (property_id, scenario)""")
def what_if(t):
    return plain(underwriting.compare_sets(t.portfolio(), DEFAULT_SET, CAUTIOUS))


# --- strategies -------------------------------------------------------------

step("o_debts", """
    SELECT property_id, arg_min(balance, seq) FILTER (WHERE is_open AND pos = '1') AS first_balance_known,
      sum(coalesce(balance, 0)) FILTER (WHERE is_open AND pos <> '1') AS junior_mortgages
    FROM o_open GROUP BY 1""")
step("o_first", """
    SELECT property_id, balance AS first_balance FROM o_open WHERE is_open AND pos = '1'
    QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY seq) = 1""")
step("o_lien_facts", """
    SELECT property_id, sum(amount) FILTER (WHERE status NOT IN ('released', 'satisfied')
        AND attachment_basis = 'recorded_against_property') AS junior_liens,
      bool_or(status NOT IN ('released', 'satisfied') AND lien_type = 'federal_tax') AS irs,
      bool_or(status <> 'released' AND lien_type = 'federal_tax') AS open_irs,
      count(*) FILTER (WHERE status <> 'released') AS open_liens,
      count(*) FILTER (WHERE status <> 'released' AND attachment_basis = 'owner_named_only' AND amount > 10000) AS large_owner_only
    FROM d_liens GROUP BY 1""")
step("o_deal", f"""
    SELECT u.*, coalesce(u.purchase_price, 0) AS price, f.published_bid, f.stage, f.nod_date, f.nts_date,
      coalesce(f.is_active, false) AS sale_active, f.postponement_count, f.rescission_count, o_first.first_balance,
      coalesce(junior_mortgages, 0) + coalesce(junior_liens, 0) AS junior, coalesce(irs, false) AS irs,
      coalesce(open_irs, false) AS open_irs, coalesce(open_liens, 0) AS open_liens,
      coalesce(large_owner_only, 0) AS large_owner_only,
      coalesce(b.active, false) AS filing_active,
      ROUND(CAST(100 * (0.30 * critical_field_coverage + 0.20 * ROUND(CAST(corroborated_fields AS DECIMAL(12,8)) / 22, 6)
        + 0.20 * CASE WHEN newest_report_date IS NOT NULL THEN 1 ELSE 0 END
        + 0.15 * (1 - least(1.0, CAST(material_conflict_count AS DECIMAL(8,4)) / 5))
        + 0.10 * ROUND(CAST(verified_field_count AS DECIMAL(12,8)) / 22, 6) + 0.05 * mean_extraction_confidence) AS DECIMAL(30,10)), 4) AS dcs
    FROM o_uw u LEFT JOIN d_foreclosure f USING (property_id) LEFT JOIN o_first USING (property_id)
      LEFT JOIN o_debts USING (property_id) LEFT JOIN o_lien_facts USING (property_id)
      LEFT JOIN (SELECT property_id, bool_or(status = 'active') AS active FROM d_bankruptcies GROUP BY 1) b USING (property_id)""")
step("o_figures", f"""
    SELECT *, {money('value * 0.8 - repairs - holding - acquisition - resale')} AS mao_cash,
      price + acquisition + repairs + holding AS cash_all_in, {money('arv * 0.0725 + 3500')} AS flip_resale,
      {money('0.85 * (price + repairs)')} AS loan,
      CAST(0.85 * (0.02 + 0.1 * months / 12) AS DOUBLE) AS coef
    FROM o_deal""")
step("o_figures2", f"""
    SELECT *, {money('value * 0.9275 - cash_all_in')} AS cash_profit,
      {money('CAST(0.02 * loan + 1200 AS DOUBLE) + CAST(loan * 0.1 AS DOUBLE) * CAST(months AS DOUBLE) / 12')} AS financing,
      {money('arv * 0.8 - repairs - holding - flip_resale - acquisition')} AS room,
      ROUND(arv * 0.7 - repairs, 2) AS threshold, ROUND(rent_estimate * 12 * 0.94, 2) AS egi,
      coalesce(published_bid, first_balance, 0) + junior + coalesce(delinquent_amount, 0) AS obligations,
      2 * {money('CAST(annual_taxes + v_low * 0.0085 AS DOUBLE) / 12 + 180 + coalesce(hoa_monthly_dues, 0)')} AS carry,
      CASE WHEN condition IS NULL THEN coalesce(ROUND(repairs_base * 1.4, 2), 0) ELSE repairs END AS sale_repairs
    FROM o_figures""")
step("o_figures3", f"""
    SELECT *, {money('(CAST(room AS DOUBLE) - coef * CAST(repairs AS DOUBLE) - 1200) / (1 + coef)')} AS mao_flip,
      price + repairs + holding + financing + acquisition + flip_resale AS flip_all_in,
      {money('''annual_taxes + value * 0.0035 + coalesce(hoa_monthly_dues, 0) * 12 + egi * 0.21''')} AS opex,
      v_low - obligations - sale_repairs - carry AS spread
    FROM o_figures2""")
step("o_strategies", f"""
    SELECT property_id, scenario, price, 'cash' AS strategy, 1 AS place,
      CASE WHEN value IS NULL OR price = 0 THEN 'no_value_data' END AS reason,
      CASE WHEN cash_profit >= 0 THEN 'viable' ELSE 'not_viable' END AS status, mao_cash AS mao, cash_all_in AS all_in_basis,
      cash_profit AS profit, {share('cash_profit', 'cash_all_in')} AS roi,
      {share('value - cash_all_in', 'value')} AS margin_of_safety FROM o_figures3
    UNION ALL SELECT property_id, scenario, price, 'flip', 2, CASE WHEN value IS NULL OR price = 0 THEN 'no_value_data'
        WHEN sqft IS NULL OR arv IS NULL THEN 'no_sqft_data' END,
      CASE WHEN arv - flip_all_in >= 0 THEN 'viable' ELSE 'not_viable' END, mao_flip, flip_all_in, arv - flip_all_in,
      {share('arv - flip_all_in', 'flip_all_in')}, {share('arv - flip_all_in', 'arv')} FROM o_figures3
    UNION ALL SELECT property_id, scenario, price, 'wholesale', 3, CASE WHEN value IS NULL THEN 'no_value_data'
        WHEN arv IS NULL OR price = 0 THEN 'no_sqft_data' END,
      CASE WHEN threshold - price >= 15000 AND dcs >= 60 THEN 'viable' ELSE 'not_viable' END, threshold - 15000, NULL,
      threshold - price, NULL, NULL FROM o_figures3
    UNION ALL SELECT property_id, scenario, price, 'rental', 4, CASE WHEN rent_estimate IS NULL THEN 'no_rent_data'
        WHEN value IS NULL OR price = 0 THEN 'no_value_data' WHEN sqft IS NULL THEN 'no_sqft_data' END,
      CASE WHEN egi - opex > 0 THEN 'viable' ELSE 'not_viable' END, NULL, NULL, egi - opex, NULL, NULL FROM o_figures3
    UNION ALL SELECT property_id, scenario, price, 'subject_to', 5, NULL, 'requires_human_review', NULL, NULL, NULL, NULL, NULL
      FROM o_figures3
    UNION ALL SELECT property_id, scenario, price, 'foreclosure', 6, CASE WHEN NOT sale_active THEN 'no_active_foreclosure'
        WHEN v_low IS NULL THEN 'no_value_data' END,
      CASE WHEN spread > 0 THEN 'viable' ELSE 'not_viable' END, NULL, NULL, spread, NULL, NULL FROM o_figures3""")
step("o_results", """
    SELECT property_id, scenario, price, strategy, place, CASE WHEN reason IS NULL THEN status ELSE 'unavailable' END AS status,
      reason AS unavailable_reason, CASE WHEN reason IS NULL THEN mao END AS mao,
      CASE WHEN reason IS NULL THEN all_in_basis END AS all_in_basis, CASE WHEN reason IS NULL THEN profit END AS profit,
      CASE WHEN reason IS NULL THEN roi END AS roi, CASE WHEN reason IS NULL THEN margin_of_safety END AS margin_of_safety
    FROM o_strategies""")


@query("STG-8_all_strategies", "STG-1 STG-2 STG-3 STG-4 STG-5 STG-6 STG-7 STG-9", sql="""
    SELECT property_id, scenario, strategy, CAST(price AS DOUBLE) AS purchase_price, status, unavailable_reason,
      CAST(mao AS DOUBLE) AS mao, CAST(all_in_basis AS DOUBLE) AS all_in_basis, CAST(profit AS DOUBLE) AS profit,
      CAST(roi AS DOUBLE) AS roi, CAST(margin_of_safety AS DOUBLE) AS margin_of_safety FROM o_results""")
def all_strategies(t):
    return plain(strategies.strategies(t.portfolio(), Assumptions()).select(
        "property_id", "scenario", "strategy", "purchase_price", "status", "unavailable_reason", "mao", "all_in_basis",
        "profit", "roi", "margin_of_safety"))


@query("STG-6_strategy_metrics", "STG-2 STG-4 STG-5 STG-6", sql=f"""
    SELECT property_id, scenario, strategy, metric, CAST(value AS DOUBLE) AS value FROM (
      SELECT property_id, scenario, 'flip' AS strategy, unnest([
          {{'metric': 'coc', 'value': CAST({share('arv - flip_all_in', 'price + repairs - loan + holding + acquisition')} AS DOUBLE)}},
          {{'metric': 'margin', 'value': CAST({share('arv - flip_all_in', 'arv')} AS DOUBLE)}},
          {{'metric': 'financing', 'value': CAST(financing AS DOUBLE)}},
          {{'metric': 'loan', 'value': CAST(loan AS DOUBLE)}}], recursive := true)
      FROM o_figures3 WHERE value IS NOT NULL AND price <> 0 AND sqft IS NOT NULL
      UNION ALL SELECT property_id, scenario, 'rental', unnest([
          {{'metric': 'egi', 'value': CAST(egi AS DOUBLE)}}, {{'metric': 'opex', 'value': CAST(opex AS DOUBLE)}},
          {{'metric': 'noi', 'value': CAST(egi - opex AS DOUBLE)}}, {{'metric': 'cash_flow', 'value': CAST(egi - opex AS DOUBLE)}},
          {{'metric': 'cap_rate', 'value': CAST({share('egi - opex', 'price')} AS DOUBLE)}},
          {{'metric': 'coc', 'value': CAST({share('egi - opex', 'price + acquisition + repairs')} AS DOUBLE)}}],
          recursive := true)
      FROM o_figures3 WHERE rent_estimate IS NOT NULL AND value IS NOT NULL AND price <> 0 AND sqft IS NOT NULL
      UNION ALL SELECT property_id, scenario, 'subject_to', unnest([
          {{'metric': 'condition_balance_le_80pct_value', 'value': CAST(CASE WHEN first_balance IS NOT NULL AND value <> 0
             THEN CASE WHEN first_balance <= 0.8 * value THEN 1 ELSE 0 END END AS DOUBLE)}},
          {{'metric': 'condition_no_acceleration', 'value': CASE WHEN sale_active THEN 0.0 ELSE 1.0 END}},
          {{'metric': 'condition_distress_present', 'value': CASE WHEN sale_active OR filing_active
             OR coalesce(delinquent_amount, 0) > 0 THEN 1.0 ELSE 0.0 END}}], recursive := true) FROM o_figures3
      UNION ALL SELECT property_id, scenario, 'foreclosure', unnest([
          {{'metric': 'total_obligations', 'value': CAST(obligations AS DOUBLE)}},
          {{'metric': 'auction_holding', 'value': CAST(carry AS DOUBLE)}},
          {{'metric': 'spread', 'value': CAST(spread AS DOUBLE)}},
          {{'metric': 'flag_junior_liens_present', 'value': CASE WHEN junior > 0 THEN 1.0 ELSE 0.0 END}},
          {{'metric': 'flag_irs_lien', 'value': CASE WHEN irs THEN 1.0 ELSE 0.0 END}},
          {{'metric': 'flag_hoa_super_priority', 'value': CASE WHEN hoa_has_lien THEN 1.0 ELSE 0.0 END}},
          {{'metric': 'flag_owner_occupied', 'value': CASE WHEN is_owner_occupied THEN 1.0 ELSE 0.0 END}},
          {{'metric': 'flag_interior_unknown', 'value': CASE WHEN condition IS NULL THEN 1.0 ELSE 0.0 END}},
          {{'metric': 'flag_postponements_ge_3', 'value': CASE WHEN postponement_count >= 3 THEN 1.0 ELSE 0.0 END}}],
          recursive := true)
      FROM o_figures3 WHERE sale_active AND v_low IS NOT NULL) WHERE value IS NOT NULL""")
def strategy_metrics(t):
    rows = strategies.strategies(t.portfolio(), Assumptions()).where("strategy NOT IN ('cash', 'wholesale')")
    return plain(rows.select("property_id", "scenario", "strategy", F.explode("metrics").alias("metric", "value"))
                 .where("value IS NOT NULL"))


step("o_offers", f"""
    SELECT *, CAST(value * 0.9275 AS DECIMAL(20,6)) AS net_value,
      ROUND(offer_price * 0.005 + 1500, 2) AS closing_costs, confirmed + CASE WHEN has_mortgage THEN 1200 ELSE 0 END AS payoffs
    FROM (SELECT *, unnest(list_concat(
            list_transform([0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00],
                           lambda x: {{'offer_price': CAST(ROUND(CAST(v * x / 5000 AS DECIMAL(30,10)), 0) * 5000 AS DECIMAL(16,2)),
                                  'label': CAST(NULL AS VARCHAR)}}),
            list_filter([{{'offer_price': CAST(mao_cash AS DECIMAL(16,2)), 'label': 'mao_cash'}},
                         {{'offer_price': CAST(mao_flip AS DECIMAL(16,2)), 'label': 'mao_flip'}}],
                        lambda x: x.offer_price IS NOT NULL)), recursive := true)
          FROM o_figures3 WHERE v IS NOT NULL)""")
step("o_offer_rows", f"""
    SELECT property_id, scenario, offer_price, label, payoffs, potential, closing_costs,
      offer_price - payoffs - closing_costs AS proceeds_high,
      offer_price - payoffs - closing_costs - weighted_offer AS proceeds_expected,
      offer_price - payoffs - closing_costs - potential AS proceeds_low,
      offer_price + acquisition + repairs + holding AS buyer_basis,
      {money('net_value - (offer_price + acquisition + repairs + holding)')} AS profit
    FROM o_offers""")


@query("OFR-2_offer_grid", "OFR-1 OFR-5 MTH-4", sql=f"""
    SELECT property_id, scenario, CAST(offer_price AS DOUBLE) AS offer_price, label, CAST(payoffs AS DOUBLE) AS confirmed_payoffs,
      CAST(potential AS DOUBLE) AS potential_payoffs, CAST(closing_costs AS DOUBLE) AS closing_costs,
      CAST(proceeds_high AS DOUBLE) AS proceeds_high, CAST(proceeds_expected AS DOUBLE) AS proceeds_expected,
      CAST(proceeds_low AS DOUBLE) AS proceeds_low, CAST(buyer_basis AS DOUBLE) AS buyer_basis,
      CAST(profit AS DOUBLE) AS profit, CAST({share('profit', 'buyer_basis')} AS DOUBLE) AS roi, proceeds_low < 0 AS is_short_sale
    FROM o_offer_rows""")
def offer_grid(t):
    return plain(strategies.offers(t.portfolio(), Assumptions()).drop("assumption_set_id"))


@query("OFR-3_short_sale_flags", sql="""
    SELECT DISTINCT property_id, 'short_sale:' || property_id || ':' || scenario || ':' || offer_price AS dedupe_key
    FROM o_offer_rows WHERE proceeds_low < 0""")
def short_sale_flags(t):
    return plain(strategies.short_sale_flags(strategies.offers(t.portfolio(), Assumptions()))
                 .select("property_id", "dedupe_key"))


@query("OFR-4_offer_lookup", "JOI-19 WIN-15", sql=f"""
    SELECT property_id, scenario, CAST(wanted AS DOUBLE) AS offer_price, CAST({money('p0 + (p1 - p0) * t')} AS DOUBLE) AS proceeds_low,
      CAST({money('b0 + (b1 - b0) * t')} AS DOUBLE) AS buyer_basis
    FROM (SELECT *, CASE WHEN wanted > x0 AND wanted <= x1 THEN CAST(wanted - x0 AS DOUBLE) / CAST(x1 - x0 AS DOUBLE) ELSE 0 END AS t
          FROM (SELECT g.property_id, scenario, CAST(p_retailprice * (100 + 10 * p_size) AS DECIMAL(16,2)) AS wanted,
                  offer_price AS x0, lead(offer_price) OVER w AS x1, CAST(proceeds_low AS DOUBLE) AS p0,
                  coalesce(CAST(lead(proceeds_low) OVER w AS DOUBLE), CAST(proceeds_low AS DOUBLE)) AS p1,
                  CAST(buyer_basis AS DOUBLE) AS b0,
                  coalesce(CAST(lead(buyer_basis) OVER w AS DOUBLE), CAST(buyer_basis AS DOUBLE)) AS b1,
                  row_number() OVER w AS place
                FROM (SELECT property_id, scenario, offer_price, min(proceeds_low) AS proceeds_low, min(buyer_basis) AS buyer_basis
                      FROM o_offer_rows GROUP BY 1, 2, 3) g JOIN part ON p_partkey = g.property_id
                WINDOW w AS (PARTITION BY g.property_id, scenario ORDER BY offer_price))
          WHERE (place = 1 AND wanted <= x0) OR (wanted > x0 AND wanted <= x1) OR (x1 IS NULL AND wanted > x0))""")
def offer_lookup(t):
    wanted = t.source("part").select(F.col("p_partkey").alias("property_id"),
                                     F.expr("CAST(p_retailprice * (100 + 10 * p_size) AS DECIMAL(16,2))").alias("requested_price"))
    return plain(strategies.offer_lookup(strategies.offers(t.portfolio(), Assumptions()), wanted)
                 .select("property_id", "scenario", "offer_price", "proceeds_low", "buyer_basis"))


# --- scores -----------------------------------------------------------------

def decay(when: str) -> str:
    return f"CASE WHEN {when} IS NULL OR newest_report_date IS NULL THEN 0 ELSE " \
           f"pow(0.5, greatest(0, {months(when, 'newest_report_date')}) / 18.0) END"


def four(x: str) -> str:
    return f"ROUND(CAST({x} AS DECIMAL(30,12)), 4)"


step("o_lien_points", f"""
    SELECT property_id, sum(10 * d) FILTER (WHERE is_tax AND recorded) AS tax_property,
      sum(4 * d) FILTER (WHERE is_tax AND NOT recorded) AS tax_owner, sum(3 * d) FILTER (WHERE NOT is_tax) AS other
    FROM (SELECT property_id, {decay('recording_date')} AS d, lien_type IN ('federal_tax', 'state_tax') AS is_tax,
            attachment_basis = 'recorded_against_property' AS recorded
          FROM d_liens JOIN d_core USING (property_id) WHERE status <> 'released') GROUP BY 1""")
step("o_filing_points", f"""
    SELECT property_id, sum(12 * d) FILTER (WHERE status = 'active') AS active_points,
      sum(6 * d) FILTER (WHERE status IN ('dismissed', 'discharged', 'closed')) AS prior_points, bool_or(sequence > 1) AS is_repeat
    FROM (SELECT property_id, status, sequence, {decay('filing_date')} AS d
          FROM d_bankruptcies JOIN d_core USING (property_id)) GROUP BY 1""")
step("o_listing_points", f"""
    SELECT property_id, sum(6 * pow(0.5, greatest(0, {months('coalesce(delist_date, list_date)', "DATE '2002-01-01'")}) / 18.0)) AS listing_points
    FROM d_listings WHERE status IN ('expired', 'cancelled') GROUP BY 1""")
step("o_best", """
    SELECT property_id, strategy AS best_strategy, mao AS best_mao, profit AS best_profit, roi AS best_roi, margin_of_safety AS best_margin
    FROM o_results WHERE scenario = 'expected' AND status = 'viable' AND strategy <> 'subject_to'
    QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY coalesce(profit, 0) DESC, place) = 1""")
step("o_others", """
    SELECT property_id, string_agg(strategy, ',' ORDER BY coalesce(profit, 0) DESC, place) AS others
    FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY coalesce(profit, 0) DESC, place) AS n
          FROM o_results WHERE scenario = 'expected' AND status = 'viable' AND strategy <> 'subject_to') WHERE n > 1 GROUP BY 1""")


def norm(x: str, high: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE {ratio(f'greatest(0, least(1, CAST({x} AS DOUBLE) / {high}))')} END"


step("o_score_terms", f"""
    SELECT d.*, best_strategy, others, coalesce(ROUND(CAST(CAST(v - best_mao AS DOUBLE) / CAST(v AS DOUBLE) AS DECIMAL(30,12)), 6), 0) AS discount,
      best_profit, best_roi, best_margin,
      CASE WHEN sale_active AND nts_date IS NOT NULL THEN {four(f"CASE WHEN DATE '2002-01-01' - nts_date BETWEEN 0 AND 30 THEN 30 ELSE 24 END * {decay('nts_date')}")} END AS t_nts,
      CASE WHEN sale_active AND nod_date IS NOT NULL THEN {four(f"18 * {decay('nod_date')}")} END AS t_nod,
      CASE WHEN sale_active AND rescission_count <> 0 THEN least(16, 8 * rescission_count) END AS t_prior,
      {four('active_points')} AS t_bk, CASE WHEN prior_points IS NOT NULL THEN {four('least(18, prior_points)')} END AS t_bk_prior,
      CASE WHEN is_repeat THEN 8 END AS t_repeat, CASE WHEN tax_property <> 0 THEN {four('tax_property')} END AS t_tax,
      CASE WHEN tax_owner <> 0 THEN {four('tax_owner')} END AS t_tax_owner,
      CASE WHEN coalesce(other, 0) + CASE WHEN hoa_has_lien AND hoa_arrears > 0 THEN 3 ELSE 0 END <> 0 THEN
        {four('least(12, coalesce(other, 0) + CASE WHEN hoa_has_lien AND hoa_arrears > 0 THEN 3 ELSE 0 END)')} END AS t_other,
      CASE WHEN delinquent_years >= 2 THEN 10 END AS t_taxes, CASE WHEN is_absentee THEN 5 END AS t_absentee,
      CASE WHEN years_owned > 15 THEN 4 END AS t_long,
      CASE WHEN listing_points <> 0 THEN {four('least(12, listing_points)')} END AS t_listing
    FROM o_deal d LEFT JOIN o_best USING (property_id) LEFT JOIN o_others USING (property_id)
      LEFT JOIN o_lien_points USING (property_id) LEFT JOIN o_filing_points USING (property_id)
      LEFT JOIN o_listing_points USING (property_id) WHERE scenario = 'expected'""")
TERMS = ("t_nts", "t_nod", "t_prior", "t_bk", "t_bk_prior", "t_repeat", "t_tax", "t_tax_owner", "t_other", "t_taxes",
         "t_absentee", "t_long", "t_listing")
SUMMED = " + ".join(f"coalesce({name}, 0)" for name in TERMS)
step("o_score_parts", f"""
    SELECT *, least(100, plain_distress + CASE WHEN equity_pct >= 0.50 AND plain_distress > 0 THEN 5 ELSE 0 END) AS distress,
      least(100, 6 * open_liens + CASE WHEN filing_active THEN 15 ELSE 0 END
        + CASE WHEN sale_active AND stage IN ('nts', 'auction') THEN 12 ELSE 0 END + 10 * large_owner_only
        + 10 * title_flag_count + CASE WHEN is_owner_occupied THEN 8 ELSE 0 END
        + CASE WHEN hoa_arrears > 0 THEN 8 ELSE 0 END + 10 * material_conflict_count
        + CASE WHEN dcs < 50 THEN 12 ELSE 0 END + CASE WHEN open_irs THEN 6 ELSE 0 END) AS risk,
      {four(f"100 * (0.30 * n_profit + 0.25 * n_roi + 0.20 * n_equity + 0.15 * n_discount + 0.10 * n_margin)")} AS fos
    FROM (SELECT *, {SUMMED} AS plain_distress, {norm('best_profit', '150000')} AS n_profit, {norm('best_roi', '0.5')} AS n_roi,
            {norm('equity_pct', '0.6')} AS n_equity, {norm('discount', '0.35')} AS n_discount,
            {norm('best_margin', '0.35')} AS n_margin FROM o_score_terms)""")
step("o_score", f"""
    SELECT *, {four('least(blended, CASE WHEN dcs < 40 THEN 45.0 ELSE 1000 END, CASE WHEN sale_active AND dcs < 75 THEN 70.0 ELSE 1000 END)')} AS overall
    FROM (SELECT *, greatest(0, least(100, 0.5 * fos + 0.2 * distress + 0.2 * dcs - 0.25 * risk)) AS blended FROM o_score_parts)""")


@query("SCO-5_scores", "SCO-1 SCO-2 SCO-3 SCO-4 SCO-6 SCO-7 SCO-9 WIN-10 MTH-3", sql="""
    SELECT property_id, CAST(fos AS DOUBLE) AS fos, CAST(distress AS DOUBLE) AS distress, CAST(dcs AS DOUBLE) AS data_confidence,
      CAST(risk AS DOUBLE) AS risk, CAST(overall AS DOUBLE) AS overall,
      concat_ws(',', CASE WHEN v IS NULL THEN 'insufficient_data' END, CASE WHEN dcs < 40 THEN 'dcs_below_40' END,
        CASE WHEN sale_active AND dcs < 75 THEN 'foreclosure_cap' END, CASE WHEN has_gating_flag THEN 'open_gating_flag' END) AS gates_applied,
      v IS NOT NULL AND NOT has_gating_flag AS is_rankable, best_strategy AS recommended_strategy,
      coalesce(others, '') AS recommended_alternatives
    FROM o_score""")
def scores(t):
    return plain(scoring.score(t.portfolio(), Assumptions(), DAY)
                 .drop("assumption_set_id", "scoring_config_id", "components"))


@query("SCO-8_components", "SCO-2", sql=f"""
    SELECT property_id, name, CAST(value AS DOUBLE) AS value FROM (
      SELECT property_id, unnest([{', '.join("{'name': '" + name + "', 'value': CAST(" + column + " AS DOUBLE)}" for name, column in (
          ('distress_nts', 't_nts'), ('distress_nod', 't_nod'), ('distress_prior_foreclosure', 't_prior'),
          ('distress_bankruptcy_active', 't_bk'), ('distress_bankruptcy_prior', 't_bk_prior'),
          ('distress_repeat_filings', 't_repeat'), ('distress_tax_lien_attached', 't_tax'),
          ('distress_tax_lien_owner_only', 't_tax_owner'), ('distress_other_involuntary_liens', 't_other'),
          ('distress_taxes_delinquent_2yr', 't_taxes'), ('distress_absentee', 't_absentee'),
          ('distress_owned_over_15yr', 't_long'), ('distress_listing_expired', 't_listing'),
          ('fos_profit_norm', 'n_profit'), ('fos_roi_norm', 'n_roi'), ('fos_equity_pct_norm', 'n_equity'),
          ('fos_discount_to_value_norm', 'n_discount'), ('fos_margin_of_safety_norm', 'n_margin'),
          ('risk_liens', '6 * open_liens'), ('discount_to_value', 'discount')))}], recursive := true)
      FROM o_score_parts) WHERE value IS NOT NULL""")
def components(t):
    rows = scoring.score(t.portfolio(), Assumptions(), DAY)
    # The outer form keeps the optimizer from copying the whole score expression into an emptiness filter.
    return plain(rows.select("property_id", F.explode_outer("components").alias("name", "value")).where(
        "name LIKE 'distress_%' AND name <> 'distress_high_equity_bonus' OR name LIKE 'fos_%'"
        " OR name IN ('risk_liens', 'discount_to_value')"))
