"""Why one property scores above another, and side-by-side sets of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.sql import lookup
from parcelscope.functions.text import numbers_in

TOP_DRIVERS = 5
MIN_SET, MAX_SET = 2, 4
PILLARS = "('fos', 'distress', 'dcs', 'risk')"

# Label, raw figure and format of the score terms a sentence may mention.
TERM_LABELS = {
    "fos_profit_norm": ("Financial Opportunity: expected profit", "profit", "money", "expected profit"),
    "fos_roi_norm": ("Financial Opportunity: ROI", "roi", "percent", "ROI"),
    "fos_equity_pct_norm": ("Financial Opportunity: equity %", "equity_pct", "percent", "equity share"),
    "fos_discount_to_value_norm": ("Financial Opportunity: discount to value", "discount_to_value", "percent", "discount to value"),
    "fos_margin_of_safety_norm": ("Financial Opportunity: margin of safety", "margin_of_safety", "percent", "margin of safety"),
    "distress_nts": ("Distress: notice of sale", None, None, None),
    "distress_nod": ("Distress: notice of default", None, None, None),
    "distress_prior_foreclosure": ("Distress: prior foreclosure activity", None, None, None),
    "distress_bankruptcy_active": ("Distress: active bankruptcy", None, None, None),
    "distress_bankruptcy_prior": ("Distress: prior bankruptcy", None, None, None),
    "distress_repeat_filings": ("Distress: repeat filings", None, None, None),
    "distress_tax_lien_attached": ("Distress: property tax lien", None, None, None),
    "distress_tax_lien_owner_only": ("Distress: owner-only tax lien", None, None, None),
    "distress_other_involuntary_liens": ("Distress: other involuntary liens", None, None, None),
    "distress_taxes_delinquent_2yr": ("Distress: delinquent taxes", None, None, None),
    "distress_absentee": ("Distress: absentee owner", None, None, None),
    "distress_owned_over_15yr": ("Distress: long ownership", None, None, None),
    "distress_listing_expired": ("Distress: failed listings", None, None, None),
    "distress_high_equity_bonus": ("Distress: high-equity bonus", None, None, None),
    "dcs_field_coverage": ("Data Confidence: field coverage", None, None, None),
    "dcs_corroboration": ("Data Confidence: corroboration", None, None, None),
    "dcs_recency": ("Data Confidence: report recency", None, None, None),
    "dcs_conflict_free": ("Data Confidence: conflict-freeness", None, None, None),
    "dcs_verification": ("Data Confidence: verification rate", None, None, None),
    "dcs_extraction_quality": ("Data Confidence: extraction quality", None, None, None),
    "risk_liens": ("Risk: open lien count", None, None, None),
    "risk_bankruptcy": ("Risk: active bankruptcy", None, None, None),
    "risk_foreclosure_stage": ("Risk: near-sale foreclosure stage", None, None, None),
    "risk_owner_only_liens_over_10k": ("Risk: large owner-only liens", None, None, None),
    "risk_title_flags": ("Risk: title flags", None, None, None),
    "risk_owner_occupied": ("Risk: owner-occupied", None, None, None),
    "risk_hoa_arrears": ("Risk: HOA arrears", None, None, None),
    "risk_material_conflicts": ("Risk: material conflicts", None, None, None),
    "risk_low_dcs": ("Risk: low data confidence", None, None, None),
    "risk_federal_tax_lien": ("Risk: federal tax lien", None, None, None),
}


def _compared(pairs: DataFrame, scores: DataFrame, *more: str) -> DataFrame:
    """Pairs (a_id, b_id) with the score terms of both sides as maps; a side without a score has no terms. A property has a few
    dozen terms, so they stay in the row of the pair."""
    none = F.create_map().cast(scores.schema["components"].dataType)

    def side(name: str) -> DataFrame:
        return scores.select(F.col("property_id").alias(f"{name}_id"), F.col("components").alias(f"{name}_terms"),
                             F.lit(True).alias(f"{name}_known"), *[F.col(column).alias(f"{name}_{column}") for column in more])

    both = pairs.select("a_id", "b_id").join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    return both.withColumns({name: F.coalesce(name, none) for name in ("a_terms", "b_terms")})


def _with_drivers(compared: DataFrame, top: int) -> DataFrame:
    """Compared pairs with ``drivers``: the terms that differ most, by size and then name."""
    # Risk counts against; the order of the fields is the order of the drivers.
    signed = "CAST((coalesce(x, 0) - coalesce(y, 0)) * CASE WHEN startswith(k, 'risk') THEN -1 ELSE 1 END AS DECIMAL(18,6))"
    return compared.withColumn("drivers", F.expr(f"""slice(array_sort(transform(
        filter(map_entries(map_zip_with(a_terms, b_terms, (k, x, y) -> {signed})),
               e -> e.value <> 0 AND substring_index(e.key, '_', 1) IN {PILLARS}),
        e -> named_struct('minus_size', -abs(e.value), 'name', e.key, 'point_delta', e.value))), 1, {top})"""))


def term_deltas(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Every score term of every pair (a_id, b_id) with the signed difference; a missing term counts zero, risk counts against."""
    # The outer form keeps the optimizer from copying the expression into an emptiness filter.
    rows = _compared(pairs, scores).selectExpr(
        "a_id", "b_id", "explode_outer(map_zip_with(a_terms, b_terms, (k, x, y) -> struct(x, y))) AS (name, points)").selectExpr(
        "a_id", "b_id", "name", "coalesce(points.x, 0) AS a_points", "coalesce(points.y, 0) AS b_points",
        "substring_index(name, '_', 1) AS pillar")
    return rows.where(f"pillar IN {PILLARS}").withColumn("point_delta", F.expr(
        "CAST((a_points - b_points) * CASE WHEN pillar = 'risk' THEN -1 ELSE 1 END AS DECIMAL(18,6))"))


def top_drivers(pairs: DataFrame, scores: DataFrame, top: int = TOP_DRIVERS) -> DataFrame:
    """The terms that differ most per pair, by size and then name."""
    rows = _with_drivers(_compared(pairs, scores), top).selectExpr(
        "a_id", "b_id", "a_terms", "b_terms", "posexplode_outer(drivers) AS (at, driver)").where("driver IS NOT NULL")
    return rows.selectExpr(
        "a_id", "b_id", "driver.name AS name", "coalesce(a_terms[driver.name], 0) AS a_points",
        "coalesce(b_terms[driver.name], 0) AS b_points", "substring_index(driver.name, '_', 1) AS pillar",
        "driver.point_delta AS point_delta", "at + 1 AS place")


def pillar_deltas(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    columns = ("overall", "fos", "distress", "data_confidence", "risk")

    def side(name: str) -> DataFrame:
        return scores.select(F.col("property_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return pairs.join(side("a"), "a_id").join(side("b"), "b_id").selectExpr(
        "a_id", "b_id", "a_overall", "b_overall", "a_overall - b_overall AS overall_delta", "a_fos - b_fos AS fos_delta",
        "a_distress - b_distress AS distress_delta", "a_data_confidence - b_data_confidence AS dcs_delta",
        "b_risk - a_risk AS risk_delta")


def _points(column: str) -> str:
    return f"CAST(CAST(bround({column}, 1) AS DECIMAL(18,1)) AS STRING)"


def explanations(pairs: DataFrame, scores: DataFrame, top: int = TOP_DRIVERS) -> DataFrame:
    """One sentence per pair built from the numbers alone: the gap, its drivers and what offsets them."""
    def label(at: int) -> str:
        return lookup({name: values[at] for name, values in TERM_LABELS.items() if values[at]}, "x.name", "STRING")

    raw_name = lookup({name: values[1] for name, values in TERM_LABELS.items() if values[1]}, "x.name", "STRING")

    def raw(side: str) -> str:
        return f"{side}_terms[{raw_name}]"

    def shown(side: str) -> str:
        return (f"CASE {label(2)} WHEN 'money' THEN concat('$', format_number(bround({raw(side)}, 0), 0)) "
                f"ELSE concat({_points(f'{raw(side)} * 100')}, '%') END")

    clause = (f"CASE WHEN {raw('a')} IS NOT NULL AND {raw('b')} IS NOT NULL THEN "
              f"concat(' (', {shown('a')}, ' vs ', {shown('b')}, ' ', {label(3)}, ')') ELSE '' END")
    phrase = (f"concat(coalesce({label(0)}, x.name), ' ', CASE WHEN x.point_delta > 0 THEN '+' ELSE '' END, "
              f"{_points('x.point_delta')}, ' pts', {clause})")
    drives = "(overall_delta = 0 OR x.point_delta * overall_delta > 0)"

    def listed(condition: str) -> str:
        return f"CASE WHEN size(found) > 0 THEN array_join(transform(filter(found, x -> {condition}), x -> {phrase}), '; ') END"

    terms = _with_drivers(_compared(pairs, scores, "overall").where("a_known AND b_known"), top)
    lists = terms.withColumnRenamed("drivers", "found").selectExpr("*", "a_overall - b_overall AS overall_delta") \
        .selectExpr("*", f"{listed(drives)} AS drivers", f"{listed(f'NOT {drives}')} AS offsets")
    who_a, who_b = "CAST(a_id AS STRING)", "CAST(b_id AS STRING)"
    headline = f"""CASE WHEN overall_delta = 0 THEN concat({who_a}, ' and ', {who_b}, ' are tied at ', {_points('a_overall')}, ' overall.')
        ELSE concat({who_a}, ' is ', {_points('abs(overall_delta)')}, ' points ', CASE WHEN overall_delta > 0 THEN 'above ' ELSE 'below ' END,
                    {who_b}, ' overall (', {_points('a_overall')}, ' vs ', {_points('b_overall')}, ').') END"""
    return lists.selectExpr("a_id", "b_id", f"""concat({headline},
        CASE WHEN drivers IS NULL THEN ' No scoring sub-term differs.' ELSE concat(
            CASE WHEN drivers <> '' THEN concat(' Biggest drivers: ', drivers, '.') ELSE '' END,
            CASE WHEN offsets <> '' THEN concat(' Partly offset by ', offsets, '.') ELSE '' END) END) AS explanation""")


def numbers_allowed(texts: DataFrame, payload: DataFrame) -> DataFrame:
    """Texts (id, text) whose every number occurs in the payload rows (id, number), as stated, times 100, or rounded.

    A literal that is too long for a number occurs in no payload.
    """
    mentioned = texts.select("id", F.explode_outer(F.array_distinct(numbers_in(F.col("text")))).alias("x")).select("id", "x.*")
    allowed = payload.select("id", F.explode(F.expr("""array(CAST(number AS DECIMAL(28,8)), CAST(number * 100 AS DECIMAL(28,8)),
        CAST(bround(number, 0) AS DECIMAL(28,8)), CAST(bround(number, 1) AS DECIMAL(28,8)),
        CAST(bround(number, 2) AS DECIMAL(28,8)))""")).alias("number")).distinct().withColumn("ok", F.lit(True))
    judged = mentioned.join(allowed, ["id", "number"], "left")
    return judged.groupBy("id").agg(F.count(F.coalesce(F.col("number").cast("string"), "unread")).alias("numbers"),
                                    F.bool_and(F.expr("unread IS NULL AND (number IS NULL OR ok IS NOT NULL)")).alias("is_valid"))


METRICS = (
    ("value", "v_expected", "max"), ("confirmed_debt", "confirmed", "min"), ("adjusted_equity", "adjusted_equity", "max"),
    ("overall", "overall", "max"), ("fos", "fos", "max"), ("distress", "distress", "max"),
    ("data_confidence", "data_confidence", "max"), ("risk", "risk", "min"), ("mao", "mao", "max"), ("profit", "profit", "max"),
    ("roi", "roi", "max"),
)


def key_risks(components: str = "components", gates: str = "gates_applied") -> Column:
    """Gates, then the three largest risk terms of a score."""
    return F.expr(f"""concat({gates}, transform(slice(array_sort(transform(filter(map_entries({components}),
        e -> startswith(e.key, 'risk_') AND e.value > 0), e -> struct(-e.value AS minus, e.key AS name))), 1, 3),
        x -> substr(x.name, 6)))""")


def comp_sets(sets: DataFrame, underwriting: DataFrame, scores: DataFrame, strategies: DataFrame) -> DataFrame:
    """Metric rows of sets (set_id, property_id) of two to four properties, the best known cells marked.

    A metric needs two known values to have a winner, and ties all win. The best strategy and the key risks are ``text``. A set of
    another size is refused: one row with the metric ``refused`` and the number of its properties.
    """
    numbers = sets.groupBy("set_id").agg(F.countDistinct("property_id").alias("n"))
    sized = numbers.where(f"n BETWEEN {MIN_SET} AND {MAX_SET}")
    refused = numbers.where(f"n NOT BETWEEN {MIN_SET} AND {MAX_SET}")
    members = sets.distinct().join(sized.select("set_id"), "set_id", "left_semi")
    expected = underwriting.where("scenario = 'expected'").select("property_id", "v_expected", "confirmed", "adjusted_equity")
    scored = scores.select("property_id", "overall", "fos", "distress", "data_confidence", "risk", "recommended_strategy",
                           F.array_join(key_risks(), ", ").alias("risk_notes"))
    viable = strategies.where("scenario = 'expected' AND status = 'viable'").join(
        scores.select("property_id", "recommended_strategy"), "property_id", "left")
    order = "array_position(array('cash', 'flip', 'wholesale', 'rental', 'subject_to', 'foreclosure'), strategy)"
    best = viable.groupBy("property_id").agg(F.expr(
        f"min_by(struct(strategy, mao, profit, roi), struct(NOT strategy <=> recommended_strategy, {order})) AS b")) \
        .select("property_id", F.col("b.strategy").alias("best_strategy"), F.col("b.mao").alias("mao"), F.col("b.profit").alias("profit"), F.col("b.roi").alias("roi"))
    wide = members.join(expected, "property_id", "left").join(scored, "property_id", "left").join(best, "property_id", "left")
    cells = ", ".join(f"struct('{key}' AS metric, CAST({column} AS DECIMAL(20,6)) AS value, '{side}' AS side)"
                      for key, column, side in METRICS)
    rows = wide.selectExpr("set_id", "property_id", f"inline(array({cells}))")
    ends = rows.groupBy("set_id", "metric").agg(F.count("value").alias("known"), F.max("value").alias("most"), F.min("value").alias("least"))
    cells = rows.join(ends, ["set_id", "metric"]).selectExpr(
        "set_id", "metric", "property_id", "value",
        "coalesce(known >= 2 AND value = CASE side WHEN 'max' THEN most ELSE least END, false) AS is_winner", "CAST(NULL AS STRING) AS text")
    texts = wide.selectExpr("set_id", "property_id", """inline(array(struct('best_strategy' AS metric, best_strategy AS text),
        struct('key_risks' AS metric, risk_notes AS text)))""")
    return cells.unionByName(texts.selectExpr("set_id", "metric", "property_id", "CAST(NULL AS DECIMAL(20,6)) AS value", "false AS is_winner", "text")) \
        .unionByName(refused.selectExpr("set_id", "'refused' AS metric", "NULL AS property_id", "CAST(n AS DECIMAL(20,6)) AS value",
                                        "false AS is_winner", "CAST(NULL AS STRING) AS text"))
