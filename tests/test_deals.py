"""Underwriting, strategies, offers and scores against worked results for one property each."""

from datetime import date
from decimal import Decimal as D

import pytest

from parcelscope.operators.assumptions import DEFAULT_SET, Assumptions, variant
from parcelscope.operators.scoring import score
from parcelscope.operators.strategies import offers, strategies
from parcelscope.operators.underwriting import liability_rows, underwrite
from parcelscope.schemas import portfolio

AS_OF = date(2026, 8, 1)
CAUTIOUS = variant(DEFAULT_SET, "conservative", "10000000-0000-0000-0000-000000000003",
                   repairs__low_multiplier="0.65", repairs__high_multiplier="1.6",
                   strategy__cash_target_margin="0.25",
                   strategy__flip_target_margin_by_arv_band={"default": "0.25"},
                   strategy__wholesale_investor_pct="0.65",
                   attachment_probability={"owner_named_only": "0.5", "unknown": "0.65"})


@pytest.fixture(scope="module")
def case(spark):
    """A house with an active trustee sale: bid above the derived loan balance, delinquent taxes."""
    core = spark.createDataFrame([{
        "property_id": 4, "apn": "APN-004", "sqft": D("1400"), "beds": D("3"), "is_owner_occupied": True,
        "is_absentee": False, "years_owned": D("9"), "annual_taxes": D("3600.00"), "delinquent_amount": D("8500.00"),
        "delinquent_years": 2, "condition": "heavy", "critical_field_coverage": D("0.6818"),
        "source_counts_by_field": {"mortgage.balance": 1}, "conflict_count": 0, "material_conflict_count": 0,
        "verified_field_count": 4, "newest_report_date": AS_OF, "mean_extraction_confidence": D("0.8"),
    }], "property_id long, apn string, sqft decimal(20,6), beds decimal(20,6), is_owner_occupied boolean, "
        "is_absentee boolean, years_owned decimal(9,4), annual_taxes decimal(16,2), delinquent_amount decimal(16,2), "
        "delinquent_years int, condition string, critical_field_coverage decimal(5,4), "
        "source_counts_by_field map<string,bigint>, conflict_count bigint, material_conflict_count bigint, "
        "verified_field_count bigint, newest_report_date date, mean_extraction_confidence decimal(5,4)")
    valuations = spark.createDataFrame([(4, "1", "comp", D("350000.00"), AS_OF)],
                                       "property_id long, seq string, valuation_type string, value decimal(16,2), as_of date")
    mortgages = spark.createDataFrame(
        [(4, "1", "1", D("240000.00"), D("0.065"), 360, date(2017, 8, 1), D("208270.24"), True, True)],
        "property_id long, seq string, position string, original_amount decimal(16,2), rate decimal(9,6), "
        "term_months int, origination_date date, balance decimal(16,2), balance_is_estimated boolean, is_open boolean")
    foreclosure = spark.createDataFrame(
        [(4, "nts", AS_OF, AS_OF, D("210000.00"), 2, 0, True)],
        "property_id long, stage string, nod_date date, nts_date date, published_bid decimal(16,2), "
        "postponement_count int, rescission_count int, is_active boolean")
    return portfolio(spark, core=core, valuations=valuations, mortgages=mortgages, foreclosure=foreclosure)


def by_scenario(rows, set_id):
    return {row.scenario: row for row in rows if row.assumption_set_id == set_id}


def test_underwriting_of_two_sets(case):
    rows = underwrite(case, Assumptions([DEFAULT_SET, CAUTIOUS])).collect()
    assert len(rows) == 6
    cautious = by_scenario(rows, CAUTIOUS["id"])
    assert [cautious[s].value for s in ("conservative", "expected", "optimistic")] == \
        [D("297500.00"), D("350000.00"), D("402500.00")]
    assert [cautious[s].arv for s in ("conservative", "expected", "optimistic")] == \
        [D("472220.00"), D("459200.00"), D("473480.00")]
    assert cautious["expected"].confirmed == D("218500.00")
    assert [cautious[s].net_realizable for s in ("conservative", "expected", "optimistic")] == \
        [D("47070.30"), D("98845.80"), D("149080.50")]
    assert [cautious[s].equity_pct for s in ("conservative", "expected", "optimistic")] == \
        [D("0.265546"), D("0.375714"), D("0.457143")]
    assert cautious["conservative"].acquisition == D("11037.50")
    assert cautious["conservative"].holding == D("10360.95")
    assert cautious["expected"].resale == D("25375.00")
    assert cautious["expected"].dispersion == D("0.150000")
    assert cautious["expected"].valuation_confidence == D("0.5000")


def test_breakdown_shows_the_bid_in_place_of_the_balance(case):
    rows = {row.label: row for row in liability_rows(case, Assumptions()).collect()}
    assert rows["mortgage:1"].amount == D("210000.00") and rows["mortgage:1"].is_estimated
    assert rows["delinquent_taxes"].amount == D("8500.00")


def test_strategies(case):
    rows = strategies(case, Assumptions(), price="265000").collect()
    assert len(rows) == 18
    got = {(row.strategy, row.scenario): row for row in rows}
    cash = got["cash", "conservative"]
    assert (cash.status, cash.mao, cash.all_in_basis, cash.profit) == \
        ("not_viable", D("42152.80"), D("439278.45"), D("-163347.20"))
    assert (cash.roi, cash.margin_of_safety) == (D("-0.371853"), D("-0.476566"))
    flip = got["flip", "conservative"]
    assert (flip.mao, flip.all_in_basis, flip.profit) == (D("115584.72"), D("528134.71"), D("-77754.71"))
    assert flip.metrics["coc"] == D("-0.924766") and flip.metrics["loan"] == D("355198")
    wholesale = got["wholesale", "conservative"]
    assert (wholesale.mao, wholesale.profit, wholesale.metrics["dcs"]) == \
        (D("147386.00"), D("-102614.00"), D("61.2722"))
    assert got["rental", "expected"].unavailable_reason == "no_rent_data"
    sale = got["foreclosure", "conservative"]
    assert sale.profit == D("-75261.46") and sale.metrics["auction_holding"] == D("1381.46")
    assert sale.notices == ["flag_owner_occupied (source: ownership)"]
    assert got["subject_to", "expected"].metrics["condition_no_acceleration"] == 0
    assert got["cash", "expected"].mao == D("125795.80")
    assert got["flip", "expected"].mao == D("175530.01")


def test_offers_are_linear_and_ordered(case):
    rows = [row for row in offers(case, Assumptions()).collect() if row.scenario == "expected"]
    assert len(rows) == 11
    assert {row.offer_price for row in rows if row.label is None} == {
        D(n) for n in (210000, 230000, 245000, 265000, 280000, 300000, 315000, 335000, 350000)}
    for row in rows:
        assert row.proceeds_low <= row.proceeds_expected <= row.proceeds_high
        assert row.is_short_sale == (row.proceeds_low < 0)
        assert row.confirmed_payoffs == D("219700.00")


def test_score(case):
    row = score(case, Assumptions(), AS_OF, price="265000").collect()[0]
    assert (row.fos, row.distress, row.data_confidence, row.risk) == \
        (D("12.5238"), D("58.0000"), D("61.2722"), D("20.0000"))
    assert row.overall == D("25.1163")
    assert row.gates_applied == ["foreclosure_cap"] and row.is_rankable
    assert row.components["distress_nts"] == 30 and "distress_absentee" not in row.components
    assert row.components["dcs_verification"] == D("0.181818")
    assert row.recommended_strategy is None
