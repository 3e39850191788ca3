"""Rankings and rank changes over the score history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parcelscope.operators import ranking
from parcelscope.plans.catalog import plain, query, step
from parcelscope.session import materialize

EARLIER, LATER = datetime(1998, 1, 1), datetime(2002, 1, 1)

step("o_rankable", "SELECT * FROM d_scores WHERE gate IS NULL OR gate = 'dcs_below_40'")
LATEST = """
    SELECT property_id, overall FROM o_rankable WHERE {when}
    QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY computed_on DESC NULLS LAST, score_id DESC) = 1"""
step("o_latest_early", LATEST.format(when="computed_on < DATE '1998-01-01'"))
step("o_latest", LATEST.format(when="true"))
step("o_rank_early", "SELECT *, rank() OVER (ORDER BY overall DESC, property_id) AS rank FROM o_latest_early")
step("o_rank", "SELECT *, rank() OVER (ORDER BY overall DESC, property_id) AS rank FROM o_latest")


def _snapshots(t):
    """The earlier snapshot, written as a ranking table is, and the one after it."""
    scores = t.scores()
    none = t.spark.createDataFrame([], ranking.RANKINGS)
    first = materialize(ranking.rank_scope(scores.where(F.col("computed_at") < F.lit(EARLIER)), none, "portfolio", None, EARLIER),
                        "rankings")
    return first, ranking.rank_scope(scores, first, "portfolio", None, LATER)


@query("RNK-1_ranking_snapshot", "WIN-1 WIN-2 WIN-3 JOI-1 FIL-5 SNK-8", sql="""
    SELECT property_id, CAST(o_rank.rank AS BIGINT) AS rank, CAST(o_rank_early.rank AS BIGINT) AS prev_rank,
      CAST(o_rank.overall AS DOUBLE) AS score, '2002-01-01 00:00:00' AS ranked_at
    FROM o_rank LEFT JOIN o_rank_early USING (property_id)""")
def ranking_snapshot(t):
    return plain(_snapshots(t)[1].drop("scope_type", "scope_id"))


@query("RNK-2_current_ranking", "WIN-3", sql="""
    SELECT property_id, CAST(rank AS BIGINT) AS rank, CAST(overall AS DOUBLE) AS score FROM o_rank""")
def current_ranking(t):
    first, second = _snapshots(t)
    return plain(ranking.current_ranking(first.unionByName(second), "portfolio").select("property_id", "rank", "score"))


@query("WIN-1_ranking_per_scope", "RNK-1", sql="""
    SELECT batch AS scope_id, property_id, CAST(rank() OVER (PARTITION BY batch ORDER BY overall DESC, property_id) AS BIGINT) AS rank
    FROM (SELECT batch, property_id, overall FROM o_rankable
          QUALIFY row_number() OVER (PARTITION BY batch, property_id ORDER BY computed_on DESC NULLS LAST, score_id DESC) = 1)""")
def ranking_per_scope(t):
    return plain(ranking.rank_scopes(t.scores(), LATER, "batch").select("scope_id", "property_id", "rank"))


@query("WIN-2_latest_rankable_score", "FIL-5 ARR-1", sql="""
    SELECT property_id, CAST(overall AS DOUBLE) AS overall FROM o_latest""")
def latest_rankable(t):
    return plain(ranking.latest_scores(ranking.rankable(t.scores())).select("property_id", "overall"))


@query("CAL-9_rank_changes", "WIN-13 SET-4", sql="""
    SELECT property_id, CAST(a.rank AS BIGINT) AS prev_rank, CAST(b.rank AS BIGINT) AS new_rank,
      CAST(a.rank - b.rank AS BIGINT) AS delta
    FROM (SELECT property_id, rank() OVER (ORDER BY overall DESC, CAST(property_id AS VARCHAR)) AS rank FROM o_latest_early) a
    FULL JOIN (SELECT property_id, rank() OVER (ORDER BY overall DESC, CAST(property_id AS VARCHAR)) AS rank FROM o_latest) b
      USING (property_id)""")
def rank_changes(t):
    scores = ranking.rankable(t.scores())
    before = ranking.latest_scores(scores.where(F.col("computed_at") < F.lit(EARLIER)))
    return plain(ranking.rank_changes(before, ranking.latest_scores(scores)))
