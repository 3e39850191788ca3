"""Predicted against realized deals: repairs, valuations, holding time, gut rating, score bands and weights.

Deals carry deal_id, property_id, outcome, purchase_price, actual_repairs, actual_costs, sale_price, actual_holding_days,
closed_at and the prediction snapshot: condition, predicted_repairs, predicted_holding_days, overall_score, gut_rating,
valuation_predictions and pillar_scores (maps).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.sql import lookup, number
from parcelscope.operators.assumptions import DEFAULT_SET
from parcelscope.operators.ranking import running_totals

MIN_SAMPLE = 5
WEIGHT_STEP = "0.05"
SCORE_BANDS = ((0, 45), (45, 60), (60, 70), (70, 85), (85, 101))


def realized(deals: DataFrame) -> DataFrame:
    """Profit of a closed deal, and whether it is a hit; dead or incomplete deals have none."""
    return deals.selectExpr("*", """CASE WHEN outcome <> 'dead' THEN
        CAST(sale_price - purchase_price - actual_repairs - actual_costs AS DECIMAL(16,2)) END AS realized_profit""",
                            "coalesce(realized_profit > 0, false) AS is_hit")


def repair_costs(deals: DataFrame, current: Mapping = DEFAULT_SET, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Ratio of actual to predicted repairs per condition and the rate per square foot it suggests."""
    sums = deals.where("condition IS NOT NULL AND predicted_repairs IS NOT NULL AND actual_repairs IS NOT NULL").groupBy(
        "condition").agg(F.count("*").alias("sample_size"), F.expr("CAST(sum(predicted_repairs) AS DECIMAL(22,2)) AS predicted_total"),
                         F.expr("CAST(sum(actual_repairs) AS DECIMAL(22,2)) AS actual_total"))
    psf = lookup(current["repairs"]["psf_by_condition"], "condition", "DECIMAL(10,4)")
    suggested = "CAST(bround(CAST(current_psf * actual_total AS DECIMAL(32,6)) / predicted_total, 2) AS DECIMAL(12,2))"
    return sums.selectExpr(
        "*", "CASE WHEN predicted_total > 0 THEN CAST(actual_total / predicted_total AS DECIMAL(18,10)) END AS correction_factor",
        f"{psf} AS current_psf", f"CASE WHEN sample_size >= {min_sample} AND predicted_total > 0 THEN {suggested} END AS suggested_psf")


def valuation_accuracy(deals: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Signed and absolute error per valuation type and weights by inverse error that add up to one.

    The rounding rest goes to the largest weight. There is one row per valuation type, so the windows are tiny.
    """
    errors = deals.where("sale_price > 0").select("sale_price", F.explode("valuation_predictions").alias("valuation_type", "predicted")) \
        .where("predicted IS NOT NULL").selectExpr(
            "valuation_type", "CAST((predicted - sale_price) / sale_price AS DECIMAL(20,12)) AS error")
    stats = errors.groupBy("valuation_type").agg(
        F.count("*").alias("sample_size"), F.expr("CAST(sum(error) / count(*) AS DECIMAL(20,12)) AS mean_signed_error"),
        F.expr("CAST(sum(abs(error)) / count(*) AS DECIMAL(20,12)) AS mean_abs_error"))
    whole = Window.partitionBy("qualifies")
    shares = stats.withColumn("qualifies", F.col("sample_size") >= min_sample).withColumn(
        "inverse", F.expr("CAST(1 / greatest(mean_abs_error, 0.0001) AS DECIMAL(24,12))"))
    shares = shares.withColumn("peers", F.count("*").over(whole))
    shares = shares.withColumn("total", F.sum("inverse").over(whole).cast("decimal(28,12)")) \
                   .withColumn("plain", F.expr("CAST(bround(inverse / total, 4) AS DECIMAL(8,4))"))
    first = Window.partitionBy("qualifies").orderBy(F.col("plain").desc(), "valuation_type")
    shares = shares.withColumn("rest", F.lit(1) - F.sum("plain").over(whole)).withColumn("place", F.row_number().over(first))
    return shares.selectExpr(
        "valuation_type", "sample_size", "mean_signed_error", "mean_abs_error",
        "CASE WHEN qualifies AND peers >= 2 THEN CAST(plain + CASE WHEN place = 1 THEN rest ELSE 0 END AS DECIMAL(8,4)) END AS suggested_weight")


def holding_period(deals: DataFrame, current: Mapping = DEFAULT_SET, min_sample: int = MIN_SAMPLE) -> DataFrame:
    days = current["holding"]["market_days_default"]
    sums = deals.where("predicted_holding_days IS NOT NULL AND actual_holding_days IS NOT NULL").agg(
        F.count("*").alias("sample_size"), F.sum("predicted_holding_days").alias("p"), F.sum("actual_holding_days").alias("a"))
    return sums.selectExpr(
        "sample_size", "CAST(try_divide(p, CAST(sample_size AS DECIMAL(18,0))) AS DECIMAL(18,6)) AS mean_predicted_days",
        "CAST(try_divide(a, CAST(sample_size AS DECIMAL(18,0))) AS DECIMAL(18,6)) AS mean_actual_days",
        "CAST(try_divide(a - p, CAST(sample_size AS DECIMAL(18,0))) AS DECIMAL(18,6)) AS mean_bias_days",
        f"CASE WHEN sample_size >= {min_sample} THEN greatest(0, CAST({days} + mean_bias_days AS INT)) END AS suggested_market_days")


def _average_ranks(counts: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of every distinct value, from running totals over ranges of the values."""
    totals = counts.groupBy(value).agg(F.sum("n").alias("n"))
    ranked = running_totals(totals, [], [F.col(value)], "n", "up_to")
    return ranked.select(value, (F.col("up_to") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))


def gut_correlation(deals: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Spearman correlation of gut rating and overall score; null below the sample size or when one side is constant.

    Deals are counted per distinct pair of values first, so ranks are taken over values instead of deals.
    """
    counts = deals.where("gut_rating IS NOT NULL AND overall_score IS NOT NULL").groupBy("gut_rating", "overall_score").agg(
        F.count("*").alias("n"))
    rows = counts.join(_average_ranks(counts, "gut_rating", "x"), "gut_rating").join(
        _average_ranks(counts, "overall_score", "y"), "overall_score")
    sums = rows.agg(*[F.expr(f"sum({text}) AS {name}") for text, name in (
        ("n", "n"), ("n * x", "sx"), ("n * y", "sy"), ("n * x * x", "sxx"), ("n * y * y", "syy"), ("n * x * y", "sxy"))])
    return sums.selectExpr(
        "coalesce(n, 0L) AS sample_size", f"""CASE WHEN n >= {min_sample} THEN
            try_divide(sxy - sx * sy / n, sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))) END AS coefficient""")


def score_bands(deals: DataFrame, bands=SCORE_BANDS) -> DataFrame:
    """Hits and mean profit per half-open score band; the bands are constants, and empty ones are shown."""
    arms = " ".join(f"WHEN overall_score >= {low} AND overall_score < {high} THEN {low}" for low, high in bands)
    sums = realized(deals).where("overall_score IS NOT NULL").withColumn("low", F.expr(f"CASE {arms} END")).groupBy("low").agg(
        F.count("*").alias("sample_size"), F.count_if("is_hit").alias("hits"),
        F.expr("CAST(try_divide(sum(realized_profit), count(realized_profit)) AS DECIMAL(20,6)) AS mean_realized_profit"))
    shown = deals.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({low}, {high})" for low, high in bands) + " AS t(low, high)")
    return shown.join(sums, "low", "left").selectExpr(
        "low", "high", "coalesce(sample_size, 0L) AS sample_size", "coalesce(hits, 0L) AS hits",
        "round(try_divide(CAST(hits AS DOUBLE), CAST(sample_size AS DOUBLE)), 6) AS hit_rate", "mean_realized_profit")


def pillar_separation(deals: DataFrame) -> DataFrame:
    """Mean of each pillar over hits and misses; a positive separation is higher for hits, risk counts the other way."""
    rows = realized(deals).where("realized_profit IS NOT NULL AND pillar_scores IS NOT NULL").select(
        F.expr("realized_profit > 0").alias("hit"), F.explode("pillar_scores").alias("pillar", "score"))
    mean = "CAST(try_divide(sum(score) FILTER (WHERE {0}), CAST(count(score) FILTER (WHERE {0}) AS DECIMAL(18,0))) AS DECIMAL(18,8))"
    return rows.groupBy("pillar").agg(
        F.expr(mean.format("hit")).alias("hits_mean"), F.expr(mean.format("NOT hit")).alias("misses_mean"),
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).where(
        "hits_mean IS NOT NULL AND misses_mean IS NOT NULL").withColumn("separation", F.expr(
            "CAST((hits_mean - misses_mean) * CASE WHEN pillar = 'risk' THEN -1 ELSE 1 END AS DECIMAL(18,8))"))


def weight_suggestion(deals: DataFrame, weights: Mapping[str, str], min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Weights after moving a step from the pillar that separates worst to the best one, when it does not separate at all."""
    order = "array_position(array('fos', 'distress', 'dcs', 'risk'), pillar)"
    ends = pillar_separation(deals).agg(
        F.expr(f"max_by(struct(pillar, separation), struct(separation, -{order})) AS best"),
        F.expr(f"min_by(struct(pillar, separation), struct(separation, {order})) AS worst"),
        F.count("*").alias("pillars"), F.expr("min(least(hits, misses)) AS sample_size"))
    now = lookup(dict(weights), "pillar", "DECIMAL(8,4)")
    rows = ends.selectExpr("*", f"explode(map_keys(map({', '.join(f'{name!r}, 1' for name in weights)}))) AS pillar")
    shift = f"least({number(WEIGHT_STEP, 'DECIMAL(8,4)')}, {now.replace('pillar)', 'worst.pillar)')})"
    applies = (f"sample_size >= {min_sample} AND pillars >= 2 AND best.separation > 0 AND worst.separation <= 0 "
               f"AND best.pillar <> worst.pillar AND {shift} > 0")
    return rows.selectExpr(
        "pillar", f"{now} AS current_weight",
        f"""CASE WHEN {applies} THEN CAST({now} + CASE pillar WHEN best.pillar THEN {shift} WHEN worst.pillar THEN -{shift} ELSE 0 END
            AS DECIMAL(8,4)) END AS suggested_weight""", "sample_size")


def suggestions(deals: DataFrame, current: Mapping = DEFAULT_SET, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Every change the deals warrant, and only where the proposed value differs from the current one."""
    repairs = repair_costs(deals, current, min_sample).where("suggested_psf IS NOT NULL AND NOT suggested_psf <=> current_psf").selectExpr(
        "'repair_psf' AS kind", "concat('repairs.psf_by_condition.', condition) AS target", "CAST(current_psf AS DECIMAL(18,6)) AS current_value",
        "CAST(suggested_psf AS DECIMAL(18,6)) AS proposed_value", "sample_size",
        """concat('Actual repairs run ', CAST(CAST(bround(correction_factor, 4) AS DECIMAL(18,4)) AS STRING), 'x the prediction across ',
           CAST(sample_size AS STRING), ' ''', condition, ''' deals.') AS rationale""")
    now = lookup(current.get("valuation_weights") or {}, "valuation_type", "DECIMAL(18,6)")
    weights = valuation_accuracy(deals, min_sample).where("suggested_weight IS NOT NULL").selectExpr("*", f"{now} AS weight_now").where(
        "NOT CAST(suggested_weight AS DECIMAL(18,6)) <=> weight_now").selectExpr(
        "'valuation_weights'", "concat('valuation_weights.', valuation_type)", "weight_now", "CAST(suggested_weight AS DECIMAL(18,6))",
        "sample_size", "concat('Mean absolute error ', CAST(CAST(bround(mean_abs_error, 4) AS DECIMAL(18,4)) AS STRING), '.')")
    days = current["holding"]["market_days_default"]
    holding = holding_period(deals, current, min_sample).where(f"suggested_market_days <> {days}").selectExpr(
        "'holding_market_days'", "'holding.market_days_default'", f"CAST({days} AS DECIMAL(18,6))",
        "CAST(suggested_market_days AS DECIMAL(18,6))", "sample_size",
        """concat('Deals hold ', CAST(CAST(bround(mean_bias_days, 1) AS DECIMAL(18,1)) AS STRING), ' days ',
           CASE WHEN mean_bias_days > 0 THEN 'longer' ELSE 'shorter' END, ' than predicted on average.')""")
    return repairs.union(weights).union(holding)


def accept_suggestion(current: Mapping, target: str, proposed, set_id: str) -> dict:
    """A new version of an assumption set with one value replaced; the given set stays as it is."""
    def copy(value):
        return {key: copy(inner) for key, inner in value.items()} if isinstance(value, Mapping) else value

    changed = {**copy(current), "id": set_id, "version": int(current["version"]) + 1}
    *parents, leaf = target.split(".")
    node = changed
    for parent in parents:
        if not isinstance(node.get(parent), dict):
            raise ValueError(f"unsupported suggestion target: {target}")
        node = node[parent]
    node[leaf] = int(proposed) if leaf == "market_days_default" else str(proposed)
    return changed


def accept_weights(config: Mapping, proposed: Mapping[str, str]) -> dict:
    """A new scoring configuration version with other overall weights."""
    weights = {**config.get("weights", {}), "overall": dict(proposed)}
    return {**config, "weights": weights, "version": int(config.get("version") or 0) + 1}
