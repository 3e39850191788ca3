"""Six deal strategies and the offer grid, as expressions over underwritten rows.

All strategies of a scenario are computed in the row that carries its costs, so no join or exchange follows
underwriting; ``strategies`` turns the six structs into rows at the end.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.sql import four, money, nz, one_if, quotient, share, text, yearly_debt_service
from parcelscope.operators.assumptions import Assumptions
from parcelscope.operators.underwriting import underwritten_properties, with_scenarios
from parcelscope.schemas import Portfolio

PAYOFF_FEE = 1200
WHOLESALE_MIN_CONFIDENCE = 60
FLIP_BAND = 500000
GRID_STEP = 5000
GRID_SHARES = ("0.60", "0.65", "0.70", "0.75", "0.80", "0.85", "0.90", "0.95", "1.00")
CRITICAL_FIELD_COUNT = 22
RESULT_FIELDS = ("status", "unavailable_reason", "mao", "all_in_basis", "profit", "roi", "margin_of_safety", "metrics", "notices")
REVIEW_NOTICE = "detection only - due-on-sale / legal review required"

CORROBORATED = ("size(filter(map_values(coalesce(source_counts_by_field, CAST(map() AS MAP<STRING,BIGINT>))), "
                "n -> n >= 2))")


def data_confidence() -> str:
    """Data confidence on 0..100 from the data-quality block, with the standard weights."""
    def of_critical(count: str) -> str:
        return f"CAST(CAST({count} AS DECIMAL(6,0)) / {CRITICAL_FIELD_COUNT} AS DECIMAL(12,6))"

    conflict = "least(1, CAST(CAST(coalesce(material_conflict_count, 0) AS DECIMAL(9,0)) / 5 AS DECIMAL(12,6)))"
    return four(f"""100 * (0.30 * coalesce(critical_field_coverage, 0) + 0.20 * {of_critical(CORROBORATED)}
        + 0.20 * CASE WHEN newest_report_date IS NOT NULL THEN 1 ELSE 0 END + 0.15 * (1 - {conflict})
        + 0.10 * {of_critical('coalesce(verified_field_count, 0)')}
        + 0.05 * coalesce(mean_extraction_confidence, 0))""")


def deal_inputs(p: Portfolio, a: Assumptions, as_of: date | None = None, price: str = "purchase_price") -> DataFrame:
    """Wide rows for strategies, offers and scores: underwriting plus distress state and purchase price."""
    state = p.foreclosure.selectExpr(
        "property_id", "is_active AS sale_active", "stage AS foreclosure_stage", "nod_date", "nts_date",
        "published_bid", "postponement_count", "rescission_count")
    filings = p.bankruptcies.groupBy("property_id").agg(F.expr("bool_or(status = 'active') AS filing_active"))
    return (underwritten_properties(p, a, as_of)
            .join(state, "property_id", "left").join(filings, "property_id", "left")
            .selectExpr("*", f"CAST({nz(price)} AS DECIMAL(16,2)) AS price",
                        "coalesce(sale_active, false) AS foreclosure_active",
                        "coalesce(filing_active, false) AS bankruptcy_active", f"{data_confidence()} AS dcs"))


def _result(name: str, status: str, missing: str = "NULL", metrics: dict | None = None, notices: str = "array()",
            **figures: str) -> dict[str, str]:
    """One strategy result by field; when a reason is given for it to be missing, only that reason is filled."""
    cells = ", ".join(f"'{key}', CAST({value} AS DECIMAL(18,6))" for key, value in (metrics or {}).items())
    kinds = {"mao": "DECIMAL(16,2)", "all_in_basis": "DECIMAL(16,2)", "profit": "DECIMAL(16,2)",
             "roi": "DECIMAL(12,6)", "margin_of_safety": "DECIMAL(12,6)"}
    empty = "CAST(map() AS MAP<STRING,DECIMAL(18,6)>)"
    body = {
        "strategy": f"'{name}'", "status": f"CASE WHEN m.reason IS NULL THEN {status} ELSE 'unavailable' END",
        "unavailable_reason": "m.reason",
        **{key: f"CAST(CASE WHEN m.reason IS NULL THEN {figures.get(key, 'NULL')} END AS {kind})" for key, kind in kinds.items()},
        "metrics": f"CASE WHEN m.reason IS NULL THEN {f'map({cells})' if cells else empty} ELSE {empty} END",
        "notices": f"""CASE WHEN m.reason IS NULL THEN CAST({notices} AS ARRAY<STRING>)
                   ELSE CAST(array() AS ARRAY<STRING>) END"""}
    reason = f"{name}_missing" if missing != "NULL" else "CAST(NULL AS STRING)"
    return {field: text.replace("m.reason", reason) for field, text in body.items()}


def _reasons() -> list[str]:
    """Why a strategy cannot be computed, the first matching reason in the order of the checks."""
    def first(name: str, *checks: tuple[str, str]) -> str:
        arms = " ".join(f"WHEN {condition} THEN '{reason}'" for condition, reason in checks)
        return f"CASE {arms} END AS {name}_missing"

    no_value = ("value IS NULL OR price = 0", "no_value_data")
    return [
        first("cash", no_value),
        first("flip", no_value, ("sqft IS NULL OR arv IS NULL", "no_sqft_data")),
        first("wholesale", ("value IS NULL", "no_value_data"), ("arv IS NULL OR price = 0", "no_sqft_data")),
        first("rental", ("rent_estimate IS NULL", "no_rent_data"), no_value, ("sqft IS NULL", "no_sqft_data")),
        first("foreclosure", ("NOT foreclosure_active", "no_active_foreclosure"), ("v_low IS NULL", "no_value_data")),
    ]


def maximum_offers(a: Assumptions) -> list[str]:
    """Cash and flip maximum offers. The flip price is the closed form of price plus loan cost plus margin."""
    loan = "strategy.hard_money"
    band = "strategy.flip_target_margin_by_arv_band"
    margin = f"""CASE WHEN arv >= {FLIP_BAND} THEN coalesce({a.value(f'{band}.over_500k')}, {a.value(f'{band}.default', '0.2')})
        ELSE coalesce({a.value(f'{band}.under_500k')}, {a.value(f'{band}.default', '0.2')}) END"""
    interest = f"CAST({a.value(f'{loan}.rate', '0.1')} * months AS DECIMAL(20,10)) / 12"
    points, ltv = a.value(f"{loan}.points", "0.02"), a.value(f"{loan}.ltv", "0.85", "DECIMAL(8,6)")
    rest = f"""flip_room - loan_cost * CAST(repairs AS DECIMAL(14,2)) - {a.flat('acquisition.financing_flat')}"""
    return [
        f"""{money(f"value * (1 - {a.value('strategy.cash_target_margin', 0)}) - repairs - holding - acquisition "
                   f"- resale")} AS mao_cash""",
        f"{money(f'arv * {a.resale_pct()} + ' + a.flat('resale.staging_flat'))} AS flip_resale",
        f"{money(f'arv * (1 - {margin}) - repairs - holding - flip_resale - acquisition')} AS flip_room",
        f"CAST({ltv} * CAST({points} + {interest} AS DECIMAL(18,14)) AS DECIMAL(20,16)) AS loan_cost",
        f"{money(quotient(rest, '1 + loan_cost', 'DECIMAL(26,10)', 'DECIMAL(18,14)'))} AS mao_flip",
    ]


def with_strategies(rows: DataFrame, a: Assumptions, fields: tuple[str, ...] = RESULT_FIELDS) -> DataFrame:
    """Add the array of the six results, in priority order, to every scenario row.

    A result has the given fields. Spark doesn't prune fields inside an array, so a reader of a few fields names them: the figures
    behind the others are not computed then.
    """
    loan, rental = "strategy.hard_money", "strategy.rental"
    upkeep = a.total("holding.insurance_pct_yr", "holding.maintenance_pct_yr")
    rent_share = (f"({a.value(f'{rental}.maintenance_pct', '0.08')} + {a.value(f'{rental}.management_pct', '0.08')} "
                  f"+ {a.value(f'{rental}.reserves_pct', '0.05')})")
    ltv, rate = a.value(f"{rental}.ltv"), a.value(f"{rental}.rate")
    figures = [
        *_reasons(), *maximum_offers(a),
        f"{money('price + acquisition + repairs + holding')} AS cash_all_in",
        f"{money(f'value * (1 - {a.resale_pct()}) - cash_all_in')} AS cash_profit",
        f"{money(a.value(f'{loan}.ltv', '0.85') + ' * (price + repairs)')} AS flip_loan",
        f"""{money(f"{a.value(f'{loan}.points', '0.02')} * flip_loan + {a.flat('acquisition.financing_flat')} + "
                   f"CAST(CAST(flip_loan * {a.value(f'{loan}.rate', '0.1')} AS DECIMAL(24,8)) * months "
                   f"AS DECIMAL(28,10)) / 12")} AS flip_financing""",
        f"{money('price + repairs + holding + flip_financing + acquisition + flip_resale')} AS flip_all_in",
        f"{money('arv - flip_all_in')} AS flip_profit",
        "price + repairs - flip_loan + holding + acquisition AS flip_cash",
        f"{money('arv * ' + a.value('strategy.wholesale_investor_pct', 0) + ' - repairs')} AS investor_threshold",
        f"{money('rent_estimate * 12 * (1 - ' + a.value(f'{rental}.vacancy', '0.06') + ')')} AS rental_income",
        f"""{money(f"{nz('annual_taxes')} + value * {a.value('holding.insurance_pct_yr', 0)} "
                   f"+ {nz('hoa_monthly_dues')} * 12 + {a.value(f'{rental}.owner_utilities_monthly', 0)} * 12 "
                   f"+ rental_income * {rent_share}")} AS rental_expense""",
        f"{ltv} IS NOT NULL AND {rate} IS NOT NULL AS leveraged",
        f"{money(f'price * coalesce({ltv}, 0)')} AS rental_loan",
        f"""{yearly_debt_service('rental_loan', f'coalesce({rate}, 0)',
                                 a.value(f'{rental}.amort_years', 30))} AS rental_service""",
        f"{money('rental_income - rental_expense')} AS noi",
        "CASE WHEN leveraged THEN noi - rental_service ELSE noi END AS rental_flow",
        "price - CASE WHEN leveraged THEN rental_loan ELSE 0 END + acquisition + repairs AS rental_invested",
        "junior_mortgages + junior_liens AS junior_debt",
        f"""{money(f"coalesce(published_bid, first_balance, 0) + junior_debt + {nz('delinquent_amount')}")}
            AS sale_obligations""",
        f"""{money(f"2 * CAST({money(f"CAST({nz('annual_taxes')} + v_low * {upkeep} AS DECIMAL(26,8)) / 12 "
                                     f"+ {a.flat('holding.utilities_monthly')} + {nz('hoa_monthly_dues')}")} "
                   f"AS DECIMAL(16,2))")} AS sale_holding""",
        f"""CASE WHEN condition IS NULL THEN coalesce(
                {money(f"repairs_base * {a.value('repairs.high_multiplier', 1)}")}, 0)
            ELSE coalesce(repairs, 0) END AS sale_repairs""",
        f"{money('v_low - sale_obligations - sale_repairs - sale_holding')} AS sale_spread",
    ]
    raised = {
        "flag_junior_liens_present": ("junior_debt > 0", "mortgages/liens"),
        "flag_irs_lien": ("active_federal_lien", "liens"),
        "flag_hoa_super_priority": ("coalesce(hoa_has_lien, false)", "hoa"),
        "flag_owner_occupied": ("coalesce(is_owner_occupied, false)", "ownership"),
        "flag_interior_unknown": ("condition IS NULL", "condition"),
        "flag_postponements_ge_3": ("coalesce(postponement_count, 0) >= 3", "foreclosure"),
    }
    notes = ", ".join(f"CASE WHEN {condition} THEN '{name} (source: {source})' END"
                      for name, (condition, source) in raised.items())

    def viable(condition: str) -> str:
        return f"CASE WHEN {condition} THEN 'viable' ELSE 'not_viable' END"

    spread = "investor_threshold - price"
    least = a.flat("strategy.min_assignment_spread")
    results = [
        _result("cash", viable("cash_profit >= 0"), "checked", mao="mao_cash", all_in_basis="cash_all_in",
                profit="cash_profit", roi=share("cash_profit", "cash_all_in"),
                margin_of_safety=share("value - cash_all_in", "value")),
        _result("flip", viable("flip_profit >= 0"), "checked", mao="mao_flip", all_in_basis="flip_all_in",
                profit="flip_profit", roi=share("flip_profit", "flip_all_in"),
                margin_of_safety=share("arv - flip_all_in", "arv"),
                metrics={"coc": share("flip_profit", "flip_cash"), "margin": share("flip_profit", "arv"),
                         "financing": "flip_financing", "loan": "flip_loan"}),
        _result("wholesale", viable(f"{spread} >= {least} AND dcs >= {WHOLESALE_MIN_CONFIDENCE}"), "checked",
                mao=f"investor_threshold - {least}", profit=spread,
                metrics={"investor_threshold": "investor_threshold", "spread": spread, "dcs": "dcs"}),
        _result("rental", viable("rental_flow > 0"), "checked", profit="rental_flow",
                metrics={"egi": "rental_income", "opex": "rental_expense", "noi": "noi",
                         "cap_rate": share("noi", "price"), "cash_flow": "rental_flow",
                         "coc": share("rental_flow", "rental_invested"),
                         "dscr": f"CASE WHEN leveraged AND rental_service > 0 THEN "
                                 f"{share('noi', 'rental_service')} END"}),
        _result("subject_to", "'requires_human_review'", notices=f"array({text(REVIEW_NOTICE)})", metrics={
            "condition_rate_200bps_below_market": "NULL",
            "condition_balance_le_80pct_value":
                f"CASE WHEN first_balance IS NOT NULL AND value <> 0 THEN {one_if('first_balance <= value * 0.8')} END",
            "condition_no_acceleration": one_if("NOT foreclosure_active"),
            "condition_distress_present": one_if(
                f"foreclosure_active OR bankruptcy_active OR {nz('delinquent_amount')} > 0")}),
        _result("foreclosure", viable("sale_spread > 0"), "checked", profit="sale_spread",
                notices=f"array_compact(array({notes}))",
                metrics={"total_obligations": "sale_obligations", "auction_holding": "sale_holding",
                         "spread": "sale_spread",
                         **{name: one_if(condition) for name, (condition, _) in raised.items()}}),
    ]
    structs = [", ".join(f"'{field}', {result[field]}" for field in ("strategy", *fields)) for result in results]
    entries = ", ".join(f"named_struct({cells})" for cells in structs)
    return rows.selectExpr("*", *figures).selectExpr("*", f"array({entries}) AS results")


def strategies(p: Portfolio, a: Assumptions, as_of: date | None = None, price: str = "purchase_price",
               fields: tuple[str, ...] = RESULT_FIELDS) -> DataFrame:
    """The strategies table: one row per property, set, scenario and strategy."""
    return strategy_rows(with_strategies(with_scenarios(deal_inputs(p, a, as_of, price), a), a, fields), fields)


def strategy_rows(rows: DataFrame, fields: tuple[str, ...] = RESULT_FIELDS) -> DataFrame:
    """The results as rows; the financing costs are there when the metrics are."""
    financing = ["CAST(coalesce(try_element_at(metrics, 'financing'), base_financing) AS DECIMAL(16,2)) AS financing"]
    return (rows.selectExpr("property_id", "assumption_set_id", "scenario", "price AS purchase_price", "arv",
                            "repairs", "holding", "financing AS base_financing", "resale", "inline(results)")
            .selectExpr("property_id", "assumption_set_id", "scenario", "strategy", "purchase_price", "arv", "repairs",
                        "holding", *(financing if "metrics" in fields else []), "resale", *fields))


def offer_figures(offer: str, a: Assumptions) -> list[str]:
    """Everything a price decides for a scenario row; each figure is linear in the price."""
    return [
        f"CAST(confirmed + CASE WHEN has_mortgage_entry THEN {PAYOFF_FEE} ELSE 0 END AS DECIMAL(16,2)) AS confirmed_payoffs",
        "potential AS potential_payoffs",
        f"""{money(f"{offer} * {a.value('acquisition.title_pct', 0)} + {a.flat('acquisition.escrow_flat')}")}
            AS closing_costs""",
        f"CAST({offer} - confirmed_payoffs - closing_costs AS DECIMAL(16,2)) AS proceeds_high",
        "CAST(proceeds_high - potential_weighted_offer AS DECIMAL(16,2)) AS proceeds_expected",
        "CAST(proceeds_high - potential AS DECIMAL(16,2)) AS proceeds_low",
        f"CAST({offer} + acquisition + repairs + holding AS DECIMAL(16,2)) AS buyer_basis",
        f"{money(f'value * (1 - {a.resale_pct()}) - buyer_basis')} AS profit",
        f"{share('profit', 'buyer_basis')} AS roi",
        "proceeds_low < 0 AS is_short_sale",
    ]


OFFER_KEYS = ("property_id", "assumption_set_id", "scenario")
INTERPOLATED = ("confirmed_payoffs", "potential_payoffs", "closing_costs", "proceeds_low", "proceeds_expected",
                "proceeds_high", "buyer_basis", "profit")


def offers_of(rows: DataFrame, a: Assumptions) -> DataFrame:
    """Nine prices from 60 to 100 percent of the expected value plus the two maximum offers.

    ``rows`` are scenario rows; the maximum offers are added when they are not there yet.
    """
    if "mao_cash" not in rows.columns:
        rows = rows.selectExpr("*", *maximum_offers(a))

    def entry(offer: str, label: str) -> str:
        return (f"CASE WHEN {offer} IS NOT NULL THEN named_struct('offer_price', CAST({offer} AS DECIMAL(16,2)), "
                f"'label', CAST({label} AS STRING)) END")

    grid = [entry(f"ROUND(v_expected * {part} / {GRID_STEP}, 0) * {GRID_STEP}", "NULL") for part in GRID_SHARES]
    entries = ", ".join([*grid, entry("mao_cash", "'mao_cash'"), entry("mao_flip", "'mao_flip'")])
    needed = ("confirmed", "potential", "potential_weighted_offer", "has_mortgage_entry", "acquisition", "repairs",
              "holding", "value")
    priced = (rows.where("status = 'ok'")
              .selectExpr(*OFFER_KEYS, *needed, f"inline(array_compact(array({entries})))"))
    return priced.selectExpr(*OFFER_KEYS, "offer_price", "label", *offer_figures("offer_price", a))


def offers(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """The offers table: one row per property, set, scenario and price."""
    return offers_of(with_scenarios(deal_inputs(p, a, as_of), a), a)


def short_sale_flags(offers_table: DataFrame) -> DataFrame:
    """A flag request for every offer whose low proceeds are negative."""
    return (offers_table.where("is_short_sale")
            .selectExpr("property_id", "'short_sale_candidate' AS flag_type", "CAST(NULL AS DECIMAL(16,2)) AS impact",
                        """concat_ws(':', 'short_sale', CAST(property_id AS STRING), scenario,
                           CAST(offer_price AS STRING)) AS dedupe_key""")
            .dropDuplicates(["dedupe_key"]))


def offer_lookup(offers_table: DataFrame, requests: DataFrame) -> DataFrame:
    """Figures at a requested price, read between the two grid prices around it and held at the ends.

    Grid points are numbered within property and scenario (eleven at most) and joined with the requests on
    that key, so the range condition only filters a bounded set.
    """
    points = offers_table.groupBy(*OFFER_KEYS, "offer_price").agg(
        *[F.min(name).alias(name) for name in (*INTERPOLATED, "roi", "is_short_sale")])
    order = Window.partitionBy(*OFFER_KEYS).orderBy("offer_price")
    ahead = points.select("*", F.row_number().over(order).alias("place"),
                          *[F.lead(name).over(order).alias(f"next_{name}")
                            for name in ("offer_price", *INTERPOLATED, "roi")])
    wanted = "CAST(requested_price AS DECIMAL(16,2))"
    hit = ahead.join(requests, "property_id").selectExpr("*", f"{wanted} AS wanted").where("""
        (place = 1 AND wanted <= offer_price) OR (wanted > offer_price AND wanted <= next_offer_price)
        OR (next_offer_price IS NULL AND wanted > offer_price)""")
    inside = "wanted > offer_price AND wanted <= next_offer_price"

    def between(name: str, places: int, kind: str) -> str:
        first, second = f"CAST({name} AS DOUBLE)", f"CAST(coalesce(next_{name}, {name}) AS DOUBLE)"
        return f"CAST(ROUND(CAST({first} + ({second} - {first}) * along AS DECIMAL(24,8)), {places}) AS {kind})"

    part = "CAST(wanted - offer_price AS DOUBLE) / CAST(next_offer_price - offer_price AS DOUBLE)"
    return hit.selectExpr("*", f"CASE WHEN {inside} THEN {part} ELSE 0D END AS along").selectExpr(
        *OFFER_KEYS, "wanted AS offer_price",
        *[f"{between(name, 2, 'DECIMAL(16,2)')} AS {name}" for name in INTERPOLATED],
        f"{between('roi', 6, 'DECIMAL(12,6)')} AS roi",
        f"""CASE WHEN {inside} THEN wanted < {between('confirmed_payoffs', 2, 'DECIMAL(16,2)')}
            ELSE is_short_sale END AS is_short_sale""")
