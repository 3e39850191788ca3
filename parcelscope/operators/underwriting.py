"""Underwriting: value blend, liability buckets, costs and equity per property, assumption set and scenario.

Every input table is reduced to one row per property before it meets the others, so the job is one exchange
per table on ``property_id``; everything after that is row-local arithmetic.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.lookups import INACTIVE_LIEN_STATUSES, VALUATION_TYPE_WEIGHT
from parcelscope.functions.sql import (
    amortised_balance,
    clamp,
    elapsed,
    four,
    half_life,
    lookup,
    money,
    number,
    nz,
    one_of,
    position,
    quotient,
    ratio,
    share,
)
from parcelscope.operators.assumptions import Assumptions
from parcelscope.schemas import Portfolio

AVM_HALF_LIFE_DAYS = 90
SINGLE_CANDIDATE_DISPERSION = "0.15"
DISPERSION_RANGE = ("0.04", "0.30")
BID_TOLERANCE = "0.20"
HOLDING_FACTORS = {"conservative": "1.5", "expected": "1", "optimistic": "0.75"}
INACTIVE = one_of(INACTIVE_LIEN_STATUSES)


def reference_date(as_of: date | None) -> Column:
    """The anchor of every date-relative term: a given day, else the newest report of the property."""
    return F.lit(as_of).cast("date") if as_of is not None else F.col("newest_report_date")


def subjects(core: DataFrame, as_of: date | None) -> DataFrame:
    return core.select("property_id", reference_date(as_of).alias("ref_date"), F.col("sqft").alias("subject_sqft"))


def comp_quality(p: Portfolio, as_of: date | None = None) -> DataFrame:
    """Weight factor and price range of the usable comparables of a property.

    Means are compared as sums against bound times count, so no quotient is rounded.
    """
    comps = (p.comparables.where("included AND price IS NOT NULL")
             .join(subjects(p.core, as_of), "property_id")
             .selectExpr("property_id", "price", "distance", "subject_sqft",
                         "sale_date IS NOT NULL AND ref_date IS NOT NULL AS dated",
                         f"{elapsed('datediff(ref_date, sale_date)')} AS days",
                         "coalesce(sqft <> 0 AND subject_sqft <> 0, false) AS sized",
                         "abs(sqft - subject_sqft) AS delta"))
    facts = comps.groupBy("property_id").agg(*[F.expr(text) for text in (
        "count(*) AS n", "count(distance) AS n_distance", "sum(CAST(distance AS DECIMAL(14,6))) AS distance_sum",
        "count_if(dated) AS n_dated", "sum(CASE WHEN dated THEN days END) AS days_sum",
        "count_if(sized) AS n_sized", "sum(CASE WHEN sized THEN CAST(delta AS DECIMAL(14,6)) END) AS delta_sum",
        "CAST(max(subject_sqft) AS DECIMAL(14,6)) AS subject", "min(price) AS comp_price_low",
        "max(price) AS comp_price_high")])

    def step(known: str, total: str, good: str, fair: str) -> str:
        return f"CASE WHEN {known} = 0 OR {total} <= {good} THEN 1.00 WHEN {total} <= {fair} THEN 0.90 ELSE 0.80 END"

    base = "subject * CAST(n_sized AS DECIMAL(9,0))"
    factor = " * ".join((
        "CASE WHEN n >= 5 THEN 1.00 WHEN n >= 3 THEN 0.85 ELSE 0.70 END",
        step("n_distance", "distance_sum", "n_distance", "2 * n_distance"),
        step("n_dated", "days_sum", "180 * n_dated", "365 * n_dated"),
        step("n_sized", "delta_sum", f"{base} * 0.1", f"{base} * 0.2")))
    return facts.selectExpr("property_id", "n",
                            f"CAST(greatest(0.3, least(1.0, {factor})) AS DECIMAL(12,8)) AS comp_factor",
                            "comp_price_low", "comp_price_high")


def candidate_weights(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """Every valuation with its weight: base weight of the type times age or comparable quality."""
    rows = (a.expand(p.valuations)
            .join(subjects(p.core, as_of).select("property_id", "ref_date"), "property_id")
            .join(comp_quality(p, as_of).drop("n"), "property_id", "left"))
    kind = "lower(valuation_type)"
    base = f"coalesce({a.lookup('valuation_weights', kind)}, {lookup(VALUATION_TYPE_WEIGHT, kind)}, {number(1)})"
    age = f"coalesce({half_life(elapsed('datediff(ref_date, as_of)'), AVM_HALF_LIFE_DAYS)}, 1D)"
    avm = ratio(f"CAST(CAST({base} * coalesce(reported_confidence, 1) AS DOUBLE) * {age} AS DECIMAL(20,12))")
    comp = ratio(f"{base} * coalesce(comp_factor, 1)")
    return rows.withColumn("weight", F.expr(f"""
        CASE WHEN value IS NULL THEN NULL WHEN {kind} = 'avm' THEN {avm}
             WHEN contains({kind}, 'comp') THEN {comp} ELSE {base} END"""))


def valuation_blend(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """Weighted value, its spread and the clamped low and high value per property and set.

    The weighted variance is taken from sums of w, w*v and w*v*v in exact decimals, in the same pass.
    """
    rows = candidate_weights(p, a, as_of).selectExpr(
        *a.keys, "CASE WHEN value IS NOT NULL THEN CAST(value AS DECIMAL(14,2)) END AS v",
        "CAST(weight AS DECIMAL(8,6)) AS w", "contains(lower(valuation_type), 'comp') AS is_comp", "value_low",
        "value_high", "comp_price_low", "comp_price_high")
    sums = rows.groupBy(*a.keys).agg(*[F.expr(text) for text in (
        "count(v) AS candidates", "CAST(sum(w) AS DECIMAL(11,6)) AS weight_sum",
        "CAST(sum(w * v) AS DECIMAL(23,8)) AS wv", "sum(w * (v * v)) AS wvv",
        "least(min(CASE WHEN is_comp THEN value_low END), max(comp_price_low)) AS comp_range_low",
        "greatest(max(CASE WHEN is_comp THEN value_high END), max(comp_price_high)) AS comp_range_high")])
    squares = "wvv - (m * wv + m * wv) + CAST(m * m AS DECIMAL(26,4)) * weight_sum"
    variance = quotient(f"greatest(CAST({squares} AS DECIMAL(30,10)), 0)", "weight_sum", "DECIMAL(30,10)",
                        "DECIMAL(11,6)")
    spread = f"CASE WHEN m = 0 THEN 0.3D ELSE sqrt(CAST({variance} AS DOUBLE)) / CAST(m AS DOUBLE) END"
    bounded = clamp(ratio(f"CAST({spread} AS DECIMAL(24,12))"), *DISPERSION_RANGE)
    return sums.selectExpr(
        *a.keys, "candidates", "weight_sum", "wv", "wvv", "comp_range_low", "comp_range_high",
        f"{money(quotient('wv', 'weight_sum', 'DECIMAL(23,8)', 'DECIMAL(11,6)'))} AS v_expected",
        "CAST(v_expected AS DECIMAL(14,2)) AS m",
        f"""CASE WHEN m IS NULL THEN NULL WHEN candidates = 1 THEN {number(SINGLE_CANDIDATE_DISPERSION)}
            ELSE CAST({bounded} AS DECIMAL(12,6)) END AS dispersion""",
        f"""CASE WHEN m IS NOT NULL THEN
            {money('greatest(v_expected * (1 - dispersion), coalesce(comp_range_low, 0))')} END AS v_low""",
        f"""CASE WHEN m IS NOT NULL THEN
            {money('least(v_expected * (1 + dispersion), comp_range_high)')} END AS v_high""",
    ).drop("wv", "wvv", "m")


def published_bids(p: Portfolio) -> DataFrame:
    return (p.foreclosure.where("is_active AND published_bid IS NOT NULL")
            .selectExpr("property_id", "published_bid AS bid"))


def open_positions(p: Portfolio) -> DataFrame:
    """The highest reported balance of every open position; the first listed wins a tie.

    A partial aggregate picks the row, so a property with very many mortgages is reduced before the exchange.
    """
    return (p.mortgages.where("is_open")
            .withColumn("position", F.expr(position("position")))
            .groupBy("property_id", "position")
            .agg(F.expr("""min_by(struct(balance, balance_is_estimated, original_amount, rate, term_months,
                                         origination_date), struct(-coalesce(balance, 0), seq)) AS m"""))
            .select("property_id", "position", "m.*"))


def position_balances(p: Portfolio, as_of: date | None = None) -> DataFrame:
    """Balance per open position: reported, else amortised; an active published bid replaces the first."""
    rows = (open_positions(p)
            .join(subjects(p.core, as_of).select("property_id", "ref_date"), "property_id")
            .join(published_bids(p), "property_id", "left"))
    derived = amortised_balance("original_amount", "rate", "term_months", "origination_date", "ref_date",
                                "CASE WHEN is_heloc THEN 'heloc' ELSE 'conventional' END")
    return rows.selectExpr(
        "property_id", "position", "original_amount", "bid", "contains(lower(position), 'heloc') AS is_heloc",
        f"{derived} AS derived", "coalesce(balance, derived) AS own_balance",
        "CASE WHEN position = '1' THEN coalesce(bid, balance, derived) ELSE own_balance END AS amount",
        "balance IS NULL AND derived IS NOT NULL AS was_derived",
        "CASE WHEN was_derived THEN 'amortization_v1' ELSE 'recorded' END AS basis",
        "coalesce(CASE WHEN balance IS NOT NULL THEN balance_is_estimated END, was_derived) AS is_estimated")


def liability_rows(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """Every obligation with its bucket and its weighted share: the breakdown behind the buckets."""
    positions = position_balances(p, as_of)

    def row(label: str, amount: str, basis: str, estimated: str, bucket: str, weighted: str = "0") -> str:
        return f"""named_struct('label', {label}, 'amount', CAST({amount} AS DECIMAL(16,2)), 'basis', {basis},
            'is_estimated', {estimated}, 'bucket', '{bucket}', 'weighted', CAST({weighted} AS DECIMAL(16,2)),
            'weighted_in_offer', CAST(0 AS DECIMAL(16,2)))"""

    def spread(df: DataFrame, *rows: str) -> DataFrame:
        return (df.selectExpr("property_id", f"explode(array_compact(array({', '.join(rows)}))) AS r")
                .select("property_id", "r.*"))

    label = "concat('mortgage:', position)"
    unused = "original_amount - amount"
    undrawn = row(f"concat({label}, ':undrawn')", unused, "'undrawn_heloc_capacity'", "true", "potential", unused)
    mortgages = spread(positions.where("amount IS NOT NULL"),
                       row(label, "amount", "basis", "is_estimated", "confirmed"),
                       f"CASE WHEN is_heloc AND original_amount > amount THEN {undrawn} END")
    alone = spread(published_bids(p).join(positions.where("position = '1'").select("property_id"), "property_id",
                                          "left_anti"),
                   row("'foreclosure:published_bid'", "bid", "'published_bid'", "false", "confirmed"))
    due = spread(p.core, *[
        f"CASE WHEN {column} IS NOT NULL THEN {row(f'{name!r}', column, repr('recorded'), 'false', 'confirmed')} END"
        for name, column in (("delinquent_taxes", "delinquent_amount"), ("hoa_arrears", "hoa_arrears"))])
    plain = a.expand(mortgages.unionByName(alone).unionByName(due))

    liens = a.expand(p.liens.where(f"status NOT IN {INACTIVE}")
                     .select("property_id", "lien_type", "amount", "amount_is_estimated", "attachment_basis"))
    median = a.lookup("unknown_lien_medians", "lien_type", "DECIMAL(16,2)")
    chance = f"coalesce({a.lookup('attachment_probability', 'attachment_basis')}, 1)"
    liens = liens.selectExpr(
        *a.keys, "lien_type AS label", f"coalesce(amount, {median}, 0.00) AS owed", "attachment_basis AS basis",
        "amount IS NULL OR amount_is_estimated AS is_estimated",
        "attachment_basis = 'recorded_against_property' AS recorded",
        "CASE WHEN NOT recorded OR (amount IS NULL AND owed <> 0) THEN 'potential' ELSE 'confirmed' END AS bucket",
        f"CASE WHEN bucket = 'potential' THEN {money(f'owed * {chance}')} ELSE 0.00 END AS weighted",
        f"CASE WHEN recorded THEN 0.00 ELSE {money(f'owed * {chance}')} END AS weighted_in_offer")
    liens = liens.selectExpr(*a.keys, "label", "CAST(owed AS DECIMAL(16,2)) AS amount", "basis", "is_estimated",
                             "bucket", "CAST(weighted AS DECIMAL(16,2)) AS weighted",
                             "CAST(weighted_in_offer AS DECIMAL(16,2)) AS weighted_in_offer")
    return plain.unionByName(liens)


def liability_buckets(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    return liability_rows(p, a, as_of).groupBy(*a.keys).agg(*[F.expr(text) for text in (
        "CAST(sum(CASE WHEN bucket = 'confirmed' THEN amount ELSE 0 END) AS DECIMAL(16,2)) AS confirmed",
        "CAST(sum(CASE WHEN bucket = 'potential' THEN amount ELSE 0 END) AS DECIMAL(16,2)) AS potential",
        "CAST(sum(weighted) AS DECIMAL(16,2)) AS potential_weighted",
        "CAST(sum(weighted_in_offer) AS DECIMAL(16,2)) AS potential_weighted_offer",
        "bool_or(startswith(label, 'mortgage:')) AS has_mortgage_entry")])


def debt_profile(p: Portfolio) -> DataFrame:
    """Reported mortgage and lien facts of a property that strategies and scores read."""
    first = f"{position('position')} = '1'"
    mortgages = p.mortgages.withColumn("is_first", F.expr(first)).groupBy("property_id").agg(*[F.expr(t) for t in (
        "count(*) AS mortgage_count",
        "min_by(balance, CASE WHEN is_open AND is_first THEN seq END) AS first_balance",
        "CAST(sum(CASE WHEN is_open AND NOT is_first THEN balance END) AS DECIMAL(16,2)) AS junior_mortgages")])
    liens = p.liens.groupBy("property_id").agg(*[F.expr(text) for text in (
        "count(*) AS lien_count", "count_if(status <> 'released') AS open_liens",
        f"""CAST(sum(CASE WHEN status NOT IN {INACTIVE} AND attachment_basis = 'recorded_against_property'
                          THEN amount END) AS DECIMAL(16,2)) AS junior_liens""",
        f"bool_or(status NOT IN {INACTIVE} AND lien_type = 'federal_tax') AS active_federal_lien",
        "bool_or(status <> 'released' AND lien_type = 'federal_tax') AS open_federal_lien")])
    return mortgages.join(liens, "property_id", "full")


def underwritten_properties(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """One wide row per property and set: record, value blend, liabilities, repair and holding base."""
    rows = (a.expand(p.core)
            .join(valuation_blend(p, a, as_of), a.keys, "left")
            .join(liability_buckets(p, a, as_of), a.keys, "left")
            .join(debt_profile(p), "property_id", "left"))
    added = ("candidates", "weight_sum", "confirmed", "potential", "potential_weighted", "potential_weighted_offer",
             "has_mortgage_entry", "mortgage_count", "lien_count", "open_liens", "junior_mortgages", "junior_liens",
             "active_federal_lien", "open_federal_lien")
    kept = [name for name in rows.columns if name not in added]
    condition = "coalesce(condition, 'moderate')"

    def by_condition(path: str, fallback: str) -> str:
        return f"coalesce({a.lookup(path, condition)}, {a.lookup(path, repr('moderate'))}, {fallback})"

    psf = by_condition("repairs.psf_by_condition", "NULL")
    repair_months = by_condition("holding.repair_months_by_condition", "3")
    filled = rows.selectExpr(
        *kept, "coalesce(candidates, 0L) AS candidates", "weight_sum",
        *[f"CAST({nz(name)} AS DECIMAL(16,2)) AS {name}" for name in (
            "confirmed", "potential", "potential_weighted", "potential_weighted_offer", "junior_mortgages",
            "junior_liens")],
        *[f"coalesce({name}, false) AS {name}" for name in (
            "has_mortgage_entry", "active_federal_lien", "open_federal_lien")],
        *[f"coalesce({name}, 0L) AS {name}" for name in ("mortgage_count", "lien_count", "open_liens")])
    return a.labelled(filled.selectExpr(
        "*", "coalesce(candidates > 0 AND weight_sum <> 0, false) AS has_value",
        "CASE WHEN has_value THEN 'ok' ELSE 'insufficient_data' END AS status",
        "CASE WHEN NOT has_value THEN 'no_valuation_candidates' END AS unavailable_reason",
        """CAST(CASE WHEN NOT has_value THEN 0 WHEN candidates = 1 THEN least(mean_extraction_confidence, 0.5)
                ELSE mean_extraction_confidence END AS DECIMAL(5,4)) AS valuation_confidence""",
        "mortgage_count + lien_count > 0 AS debt_data_present",
        "CAST(confirmed + potential AS DECIMAL(16,2)) AS maximum",
        f"""{money(f"CAST(sqft AS DECIMAL(14,6)) * CAST({psf} AS DECIMAL(10,4)) * "
                   f"{a.value('repairs.regional_index', 1, 'DECIMAL(8,4)')}")} AS repairs_base""",
        f"""CAST({a.value('holding.acquisition_months', 0)} + {repair_months}
            + {a.value('holding.market_days_default', 0)} / 30 AS DECIMAL(20,12)) AS months_base"""))


def with_scenarios(rows: DataFrame, a: Assumptions) -> DataFrame:
    """Three rows per property and set with value, costs, equity and after-repair value."""
    def scenario(name: str, value: str, repair: str, potential: str) -> str:
        return f"""named_struct('scenario', '{name}', 'value', {value}, 'repair_cost',
            CASE WHEN {value} IS NOT NULL THEN {repair} END,
            'holding_factor', CAST({HOLDING_FACTORS[name]} AS DECIMAL(4,2)),
            'potential_used', CAST({potential} AS DECIMAL(16,2)))"""

    high = money(f"repairs_base * {a.value('repairs.high_multiplier', 1)}")
    low = money(f"repairs_base * {a.value('repairs.low_multiplier', 1)}")
    cases = ", ".join((scenario("conservative", "v_low", high, "potential"),
                       scenario("expected", "v_expected", "repairs_base", "potential_weighted"),
                       scenario("optimistic", "v_high", low, "0")))
    upkeep = a.total("holding.insurance_pct_yr", "holding.maintenance_pct_yr")
    return (rows.selectExpr("*", f"explode(array({cases})) AS s").selectExpr("*", "s.*").drop("s").selectExpr(
        "*", f"{four('months_base * holding_factor')} AS months",
        f"""{money(f"CAST({nz('annual_taxes')} + value * {upkeep} AS DECIMAL(26,8)) / 12 "
                   f"+ {a.flat('holding.utilities_monthly')} + {nz('hoa_monthly_dues')}")} AS monthly_cost""",
        f"{money('monthly_cost * months')} AS holding",
        f"{money(f'value * {a.acquisition_pct()} + {a.acquisition_flat()}')} AS acquisition",
        f"{money(f'value * {a.resale_pct()}')} AS resale",
        f"CAST(CASE WHEN value IS NOT NULL THEN {nz('repair_cost')} END AS DECIMAL(16,2)) AS repairs",
        "CAST(CASE WHEN value IS NOT NULL THEN 0 END AS DECIMAL(16,2)) AS financing",
        "CAST(value + repair_cost AS DECIMAL(16,2)) AS arv",
        "CAST(value - confirmed AS DECIMAL(16,2)) AS gross_equity",
        "CAST(value - confirmed - potential_used AS DECIMAL(16,2)) AS adjusted_equity",
        f"{money(f'value * (1 - {a.resale_pct()}) - confirmed - potential_used - holding')} AS net_realizable",
        f"{share('gross_equity', 'value')} AS equity_pct"))


UNDERWRITING_COLUMNS = (
    "property_id", "assumption_set_id", "scenario", "status", "unavailable_reason", "candidates", "value",
    "v_low", "v_expected", "v_high", "dispersion", "valuation_confidence", "arv", "acquisition", "repairs",
    "holding", "resale", "financing", "months", "confirmed", "potential", "maximum", "potential_weighted",
    "potential_weighted_offer", "gross_equity", "adjusted_equity", "net_realizable", "equity_pct",
    "debt_data_present", "has_mortgage_entry",
)


def underwrite(p: Portfolio, a: Assumptions, as_of: date | None = None) -> DataFrame:
    """The underwriting table: one row per property, assumption set and scenario."""
    return with_scenarios(underwritten_properties(p, a, as_of), a).select(*UNDERWRITING_COLUMNS)


def bid_mismatches(p: Portfolio, as_of: date | None = None) -> DataFrame:
    """Active bids more than a fifth away from the balance of the first mortgage."""
    balance = amortised_balance("original_amount", "rate", "term_months", "origination_date", "ref_date",
                                "'conventional'")
    first = (p.mortgages.where(f"is_open AND {position('position')} = '1'")
             .join(subjects(p.core, as_of).select("property_id", "ref_date"), "property_id")
             .selectExpr("property_id", "seq", f"coalesce(balance, {balance}) AS own").where("own IS NOT NULL")
             .groupBy("property_id").agg(F.min_by("own", "seq").alias("first_balance")))
    return (published_bids(p).join(first, "property_id")
            .where(f"bid <> 0 AND abs(bid - first_balance) > abs(bid) * {BID_TOLERANCE}")
            .selectExpr("property_id", "bid", "first_balance",
                        "CAST(abs(bid - first_balance) AS DECIMAL(16,2)) AS impact",
                        f"{share('abs(bid - first_balance)', 'bid')} AS divergence"))


def finance_flags(p: Portfolio, as_of: date | None = None) -> DataFrame:
    """Flag requests of the engine: bid mismatch and liens without an amount."""
    mismatch = bid_mismatches(p, as_of).selectExpr(
        "property_id", "'bid_mismatch' AS flag_type", "impact",
        "concat_ws(':', 'bid-mismatch', CAST(bid AS STRING), CAST(first_balance AS STRING)) AS dedupe_key")
    unknown = p.liens.where(f"amount IS NULL AND status NOT IN {INACTIVE}").selectExpr(
        "property_id", "'missing_lien_amount' AS flag_type", "CAST(NULL AS DECIMAL(16,2)) AS impact",
        "concat_ws(':', 'missing-lien-amount', lien_type, seq) AS dedupe_key")
    return mismatch.unionByName(unknown)


def compare_sets(p: Portfolio, current: dict, candidate: dict, as_of: date | None = None) -> DataFrame:
    """What-if: both sets in one run, old and new figures side by side per property and scenario."""
    both = Assumptions([current, candidate])
    measures = ("adjusted_equity", "net_realizable", "arv", "repairs")

    def of(set_id: str, suffix: str) -> list[Column]:
        return [F.max(F.when(F.col("assumption_set_id") == set_id, F.col(name))).alias(f"{name}_{suffix}")
                for name in measures]

    out = underwrite(p, both, as_of).groupBy("property_id", "scenario").agg(
        *of(both.ids[0], "now"), *of(both.ids[1], "then"))
    return out.withColumn("adjusted_equity_change",
                          F.expr("CAST(adjusted_equity_then - adjusted_equity_now AS DECIMAL(16,2))"))
