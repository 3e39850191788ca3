"""Scores per property: opportunity, distress, data confidence, risk, the gated overall score and its parts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.lookups import STRATEGIES
from parcelscope.functions.sql import (
    calendar_months,
    elapsed,
    four,
    half_life,
    number,
    nz,
    one_of,
    quotient,
    ratio,
    unit_interval,
)
from parcelscope.operators.assumptions import Assumptions
from parcelscope.operators.strategies import CORROBORATED, RESULT_FIELDS, deal_inputs, with_strategies
from parcelscope.operators.underwriting import with_scenarios
from parcelscope.schemas import Portfolio

EVENT_HALF_LIFE_MONTHS = 18
NTS_NEAR_DAYS = 30
FORECLOSURE_CONFIDENCE = "75"
FORECLOSURE_CAP = "70"

# The scoring configuration used when no other is active.
DEFAULT_CONFIG = {
    "id": "00000000-0000-0000-0000-000000000000",
    "version": 0,
    "weights": {
        "overall": {"fos": "0.50", "distress": "0.20", "dcs": "0.20", "risk": "0.25"},
        "fos": {"profit": "0.30", "roi": "0.25", "equity_pct": "0.20", "discount_to_value": "0.15",
                "margin_of_safety": "0.10"},
        "dcs": {"coverage": "0.30", "corroboration": "0.20", "recency": "0.20", "conflict": "0.15",
                "verification": "0.10", "extraction": "0.05"},
    },
    "bounds": {
        "profit": ("0", "150000"), "roi": ("0", "0.50"), "equity_pct": ("0", "0.60"),
        "discount_to_value": ("0", "0.35"), "margin_of_safety": ("0", "0.35"),
        "critical_field_count": "22", "conflict_penalty_divisor": "5", "dcs_recency_half_life_days": "180",
        "distress_decay_half_life_months": "18", "nts_near_days": "30", "owner_only_lien_threshold": "10000",
        "high_equity_threshold": "0.50", "years_owned_threshold": "15", "delinquent_years_threshold": "2",
        "near_tie_points": "5",
    },
    "distress_points": {
        "nts_near": "30", "nts_far": "24", "nod": "18", "prior_foreclosure_each": "8",
        "prior_foreclosure_cap": "16", "bankruptcy_active": "12", "bankruptcy_prior_each": "6",
        "bankruptcy_prior_cap": "18", "repeat_filings": "8", "tax_lien_property": "10", "tax_lien_owner": "4",
        "other_lien_each": "3", "other_lien_cap": "12", "taxes_delinquent": "10", "absentee": "5",
        "long_ownership": "4", "listing_failure_each": "6", "listing_failure_cap": "12", "high_equity_bonus": "5",
    },
    "risk_points": {
        "lien_count": "6", "active_bankruptcy": "15", "foreclosure_stage": "12", "owner_only_lien": "10",
        "title_flag": "10", "owner_occupied": "8", "hoa_arrears": "8", "material_conflict": "10",
        "low_confidence": "12", "federal_tax_lien": "6",
    },
    "gates": {"dcs_cap_threshold": "40", "dcs_cap": "45", "dcs_low_threshold": "50"},
}

# Classes of liens, filings, listings and stages the points are given for.
TAX_LIEN_TYPES = ("tax", "property_tax", "state_tax", "federal_tax")
PRIOR_BANKRUPTCY_STATUSES = ("dismissed", "discharged", "closed")
FAILED_LISTING_STATUSES = ("expired", "cancelled")
NEAR_SALE_STAGES = ("nts", "auction")

#: What scores read of a strategy result.
SCORED_FIELDS = ("status", "mao", "profit", "roi", "margin_of_safety")


def merged_config(override: Mapping | None = None) -> dict:
    """The default configuration with the sections and entries of an override laid over it."""
    def over(base, change):
        if isinstance(base, Mapping) and isinstance(change, Mapping):
            return {**base, **{key: over(base.get(key), value) for key, value in change.items()}}
        return base if change is None else change

    return over(DEFAULT_CONFIG, dict(override or {}))


def _event_decay(when: str) -> str:
    """Decay of a dated event against the newest report; an undated event counts nothing.

    The decay is a decimal, so sums do not depend on the order of the rows.
    """
    months = elapsed(calendar_months(when, "newest_report_date"))
    return f"CAST(coalesce({half_life(months, EVENT_HALF_LIFE_MONTHS)}, 0D) AS DECIMAL(18,15))"


def _points(config: dict, name: str, decay: str) -> str:
    each = number(config["distress_points"][name], "DECIMAL(8,4)")
    return f"CAST({each} * {decay} AS DECIMAL(24,15))"


def lien_terms(p: Portfolio, config: dict) -> DataFrame:
    """Decayed lien points per property and class, and the count of large owner-only liens."""
    rows = (p.liens.where("status <> 'released'").join(p.core.select("property_id", "newest_report_date"), "property_id")
            .selectExpr("property_id", f"lien_type IN {one_of(TAX_LIEN_TYPES)} AS is_tax",
                        "attachment_basis = 'recorded_against_property' AS recorded",
                        f"""attachment_basis = 'owner_named_only'
                            AND amount > {config['bounds']['owner_only_lien_threshold']} AS is_large""",
                        f"{_event_decay('recording_date')} AS decay"))

    def total(condition: str, name: str, alias: str) -> str:
        return f"sum(CASE WHEN {condition} THEN {_points(config, name, 'decay')} END) AS {alias}"

    return rows.groupBy("property_id").agg(*[F.expr(text) for text in (
        total("is_tax AND recorded", "tax_lien_property", "tax_property_points"),
        total("is_tax AND NOT recorded", "tax_lien_owner", "tax_owner_points"),
        total("NOT is_tax", "other_lien_each", "other_lien_points"),
        "count_if(is_large) AS large_owner_only_liens")])


def bankruptcy_terms(p: Portfolio, config: dict) -> DataFrame:
    rows = (p.bankruptcies.join(p.core.select("property_id", "newest_report_date"), "property_id")
            .selectExpr("property_id", "status", "sequence", f"{_event_decay('filing_date')} AS decay"))
    return rows.groupBy("property_id").agg(*[F.expr(text) for text in (
        f"sum(CASE WHEN status = 'active' THEN {_points(config, 'bankruptcy_active', 'decay')} END) "
        "AS bankruptcy_active_points",
        f"sum(CASE WHEN status IN {one_of(PRIOR_BANKRUPTCY_STATUSES)} "
        f"THEN {_points(config, 'bankruptcy_prior_each', 'decay')} END) AS bankruptcy_prior_points",
        "coalesce(bool_or(sequence > 1), false) AS has_repeat_filing")])


def listing_terms(p: Portfolio, config: dict, as_of: date) -> DataFrame:
    """Failed listings decay against the scoring day with the configured half-life; undated ones are fresh."""
    half = float(config["bounds"]["distress_decay_half_life_months"])
    months = elapsed(calendar_months("coalesce(delist_date, list_date)", f"DATE'{as_of}'"))
    decay = f"CAST(coalesce({half_life(months, half)}, 1D) AS DECIMAL(18,15))" if half > 0 else "1"
    return (p.listings.where(f"status IN {one_of(FAILED_LISTING_STATUSES)}").groupBy("property_id")
            .agg(F.expr(f"sum({_points(config, 'listing_failure_each', decay)}) AS listing_points")))


def _best_strategy() -> list[str]:
    """Best viable result, earlier priority winning ties, and the rest by profit."""
    order = "array(" + ", ".join(f"'{name}'" for name in STRATEGIES) + ")"
    return [
        f"""reverse(array_sort(transform(
                filter(results, r -> r.status = 'viable' AND r.strategy <> 'subject_to'),
                r -> named_struct('gain', coalesce(r.profit, 0), 'place', -array_position({order}, r.strategy),
                                  'name', r.strategy)))) AS ranked""",
        "get(ranked, 0).name AS best_name",
        "get(filter(results, r -> r.strategy = best_name), 0) AS best",
        "slice(transform(ranked, r -> r.name), 2, greatest(size(ranked) - 1, 0)) AS alternatives",
    ]


def _distress_terms(config: dict, as_of: date) -> dict[str, str]:
    points = config["distress_points"]

    def capped(cap: str, value: str) -> str:
        return four(f"least({points[cap]}, {value})")

    def given(condition: str, value) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    near = f"datediff(DATE'{as_of}', nts_date) BETWEEN 0 AND {NTS_NEAR_DAYS}"
    nts = f"CASE WHEN {near} THEN {points['nts_near']} ELSE {points['nts_far']} END"
    rescinded = "coalesce(rescission_count, 0)"
    other = (f"(coalesce(other_lien_points, 0) + CASE WHEN hoa_has_lien AND hoa_arrears > 0 "
             f"THEN {points['other_lien_each']} ELSE 0 END)")
    return {
        "distress_nts": given("foreclosure_active AND nts_date IS NOT NULL",
                              four(f"CAST({nts} AS DECIMAL(8,4)) * {_event_decay('nts_date')}")),
        "distress_nod": given("foreclosure_active AND nod_date IS NOT NULL",
                              four(_points(config, "nod", _event_decay("nod_date")))),
        "distress_prior_foreclosure": given(
            f"foreclosure_active AND {rescinded} <> 0",
            capped("prior_foreclosure_cap", f"{points['prior_foreclosure_each']} * {rescinded}")),
        "distress_bankruptcy_active": four("bankruptcy_active_points"),
        "distress_bankruptcy_prior": given("bankruptcy_prior_points IS NOT NULL",
                                           capped("bankruptcy_prior_cap", "bankruptcy_prior_points")),
        "distress_repeat_filings": given("has_repeat_filing", points["repeat_filings"]),
        "distress_tax_lien_attached": given("tax_property_points <> 0", four("tax_property_points")),
        "distress_tax_lien_owner_only": given("tax_owner_points <> 0", four("tax_owner_points")),
        "distress_other_involuntary_liens": given(f"{other} <> 0", capped("other_lien_cap", other)),
        "distress_taxes_delinquent_2yr": given(
            f"delinquent_years >= {int(config['bounds']['delinquent_years_threshold'])}", points["taxes_delinquent"]),
        "distress_absentee": given("is_absentee", points["absentee"]),
        "distress_owned_over_15yr": given(f"years_owned > {config['bounds']['years_owned_threshold']}",
                                          points["long_ownership"]),
        "distress_listing_expired": given("listing_points <> 0", capped("listing_failure_cap", "listing_points")),
    }


def _quality_terms(config: dict) -> dict[str, tuple[str, str]]:
    """Weight name, then label and value on 0..1, of the data-confidence terms."""
    bounds = config["bounds"]

    def part(value: str) -> str:
        return ratio(f"greatest(0, least(1, coalesce({value}, 0)))")

    def of_critical(count: str) -> str:
        return part(f"try_divide(CAST({count} AS DECIMAL(9,0)), CAST({bounds['critical_field_count']} AS DECIMAL(6,0)))")

    penalty = (f"coalesce(try_divide(CAST(coalesce(material_conflict_count, 0) AS DECIMAL(9,0)), "
               f"CAST({bounds['conflict_penalty_divisor']} AS DECIMAL(6,0))), 0)")
    return {
        "coverage": ("dcs_field_coverage", part("critical_field_coverage")),
        "corroboration": ("dcs_corroboration", of_critical(CORROBORATED)),
        "recency": ("dcs_recency", ratio("CASE WHEN newest_report_date IS NOT NULL THEN 1 ELSE 0 END")),
        "conflict": ("dcs_conflict_free", ratio(f"1 - least(1, {penalty})")),
        "verification": ("dcs_verification", of_critical("coalesce(verified_field_count, 0)")),
        "extraction": ("dcs_extraction_quality", part("mean_extraction_confidence")),
    }


def _risk_terms(config: dict) -> dict[str, str]:
    points = config["risk_points"]

    def given(condition: str, name: str) -> str:
        return f"CASE WHEN {condition} THEN {points[name]} ELSE 0 END"

    def each(count: str, name: str) -> str:
        return f"{points[name]} * CAST(coalesce({count}, 0) AS DECIMAL(9,0))"

    return {
        "risk_liens": each("open_liens", "lien_count"),
        "risk_bankruptcy": given("bankruptcy_active", "active_bankruptcy"),
        "risk_foreclosure_stage": given(f"foreclosure_active AND foreclosure_stage IN {one_of(NEAR_SALE_STAGES)}",
                                        "foreclosure_stage"),
        "risk_owner_only_liens_over_10k": each("large_owner_only_liens", "owner_only_lien"),
        "risk_title_flags": each("title_flag_count", "title_flag"),
        "risk_owner_occupied": given("is_owner_occupied", "owner_occupied"),
        "risk_hoa_arrears": given("hoa_arrears > 0", "hoa_arrears"),
        "risk_material_conflicts": each("material_conflict_count", "material_conflict"),
        "risk_low_dcs": given(f"data_confidence < {config['gates']['dcs_low_threshold']}", "low_confidence"),
        "risk_federal_tax_lien": given("open_federal_lien", "federal_tax_lien"),
    }


def _weighted(weights: Mapping, values: Mapping[str, str]) -> str:
    return " + ".join(f"{number(weights[name], 'DECIMAL(8,6)')} * {value}" for name, value in values.items())


def score_rows(rows: DataFrame, config: dict, as_of: date) -> DataFrame:
    """Scores of expected-scenario rows that carry strategy results and the distress terms."""
    weights, gates = config["weights"], config["gates"]
    discount = ratio(quotient("v_expected - best.mao", "v_expected"))
    raw = {"profit": "best.profit", "roi": "best.roi", "equity_pct": "equity_pct", "discount_to_value": "discount",
           "margin_of_safety": "best.margin_of_safety"}
    norms = {f"fos_{name}_norm": unit_interval(value, *config["bounds"][name]) for name, value in raw.items()}
    distress, quality, risk = _distress_terms(config, as_of), _quality_terms(config), _risk_terms(config)
    kept = "DECIMAL(12,4)"
    base = rows.selectExpr(
        "*", *_best_strategy(), f"coalesce({discount}, 0) AS discount",
        *[f"{value} AS {name}" for name, value in norms.items()],
        *[f"CAST({value} AS {kept}) AS {name}" for name, value in distress.items()],
        *[f"{value} AS {label}" for label, value in quality.values()])
    summed = " + ".join(f"coalesce({name}, 0)" for name in distress)
    fos = _weighted(weights["fos"], {name: f"fos_{name}_norm" for name in raw})
    dcs = _weighted(weights["dcs"], {name: label for name, (label, _) in quality.items()})
    base = base.selectExpr(
        "*", f"CAST({summed} AS DECIMAL(14,4)) AS distress_sum",
        f"""CAST(CASE WHEN equity_pct >= {config['bounds']['high_equity_threshold']} AND distress_sum > 0
                 THEN {config['distress_points']['high_equity_bonus']} END AS {kept}) AS distress_high_equity_bonus""",
        "CAST(least(100, distress_sum + coalesce(distress_high_equity_bonus, 0)) AS DECIMAL(9,4)) AS distress",
        f"CAST({four(f'100 * ({fos})')} AS DECIMAL(9,4)) AS fos",
        f"CAST({four(f'100 * ({dcs})')} AS DECIMAL(9,4)) AS data_confidence",
        *[f"CAST({value} AS {kept}) AS {name}" for name, value in risk.items()])
    overall = _weighted(weights["overall"], {"fos": "fos", "distress": "distress", "dcs": "data_confidence"})
    base = base.selectExpr(
        "*", f"CAST({four('greatest(0, least(100, ' + ' + '.join(risk) + '))')} AS DECIMAL(9,4)) AS risk",
        f"greatest(0, least(100, {overall} - {number(weights['overall']['risk'], 'DECIMAL(8,6)')} * risk)) AS blended",
        f"data_confidence < {gates['dcs_cap_threshold']} AS is_unsure",
        f"foreclosure_active AND data_confidence < {FORECLOSURE_CONFIDENCE} AS is_unsure_sale",
        "coalesce(has_gating_flag, false) AS is_gated")
    parts = {
        "profit": nz("best.profit"), "roi": nz("best.roi"), "equity_pct": nz("equity_pct"),
        "discount_to_value": "discount", "margin_of_safety": nz("best.margin_of_safety"), "mao_best": nz("best.mao"),
        **{name: name for name in (*norms, *distress, "distress_high_equity_bonus",
                                   *[label for label, _ in quality.values()], *risk)},
    }
    cells = ", ".join(f"'{name}', CAST({value} AS DECIMAL(18,6))" for name, value in parts.items())
    return base.selectExpr(
        "property_id", "assumption_set_id", f"'{config['id']}' AS scoring_config_id", "fos", "distress",
        "data_confidence", "risk",
        f"""CAST({four(f"least(blended, CASE WHEN is_unsure THEN {gates['dcs_cap']} END, "
                       f"CASE WHEN is_unsure_sale THEN {FORECLOSURE_CAP} END)")} AS DECIMAL(9,4)) AS overall""",
        f"map_filter(map({cells}), (name, value) -> value IS NOT NULL) AS components",
        """array_compact(array(CASE WHEN status <> 'ok' THEN 'insufficient_data' END,
                               CASE WHEN is_unsure THEN 'dcs_below_40' END,
                               CASE WHEN is_unsure_sale THEN 'foreclosure_cap' END,
                               CASE WHEN is_gated THEN 'open_gating_flag' END)) AS gates_applied""",
        "status = 'ok' AND NOT is_gated AS is_rankable", "best_name AS recommended_strategy",
        "alternatives AS recommended_alternatives")


def score_inputs(p: Portfolio, a: Assumptions, as_of: date, config: dict, price: str = "purchase_price",
                 fields: tuple[str, ...] = RESULT_FIELDS) -> DataFrame:
    """Scenario rows with strategies and the distress terms of liens, filings and listings."""
    wide = (deal_inputs(p, a, None, price)
            .join(lien_terms(p, config), "property_id", "left")
            .join(bankruptcy_terms(p, config), "property_id", "left")
            .join(listing_terms(p, config, as_of), "property_id", "left"))
    return with_strategies(with_scenarios(wide, a), a, fields)


def score(p: Portfolio, a: Assumptions, as_of: date, override: Mapping | None = None,
          price: str = "purchase_price") -> DataFrame:
    """The scores table: one row per property and assumption set."""
    config = merged_config(override)
    rows = score_inputs(p, a, as_of, config, price, SCORED_FIELDS)
    return score_rows(rows.where("scenario = 'expected'"), config, as_of)
