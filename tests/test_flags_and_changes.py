"""Flag impacts against underwriting both arms, flag decisions, and change events of one property."""

from datetime import date
from decimal import Decimal as D

from parcelscope.operators.assumptions import Assumptions
from parcelscope.operators.changes import detect_changes
from parcelscope.operators.flags import collect_flags, list_flags, new_flags, resolve_flags
from parcelscope.operators.underwriting import underwrite
from parcelscope.schemas import portfolio

AS_OF = date(2026, 8, 1)
CORE = "property_id long, apn string, sqft decimal(20,6), condition string, newest_report_date date, mean_extraction_confidence decimal(5,4)"
LIENS = ("property_id long, seq string, lien_type string, amount decimal(16,2), amount_is_estimated boolean, status string, "
         "attachment_basis string, recording_date date")
MORTGAGES = "property_id long, seq string, position string, original_amount decimal(16,2), balance decimal(16,2), balance_is_estimated boolean, is_open boolean"
VALUES = "property_id long, seq string, valuation_type string, value decimal(16,2), as_of date"
FORECLOSURE = ("property_id long, stage string, published_bid decimal(16,2), is_active boolean, current_sale_date date, "
               "rescission_count int, postponement_count int")


def tables():
    """One property with every kind of disputed figure, as plain rows."""
    return {
        "core": [(1, "A", D(1400), "moderate", AS_OF, D("0.9"))],
        "liens": [(1, "1", "judgment", D("25000.00"), False, "active", "owner_named_only", AS_OF),
                  (1, "2", "hoa", None, False, "active", "unknown", AS_OF),
                  (1, "3", "mechanics", None, False, "active", "recorded_against_property", AS_OF)],
        "mortgages": [(1, "1", "1", D("250000.00"), D("200000.00"), False, True),
                      (1, "2", "1", D("250000.00"), D("150000.00"), False, True),
                      (1, "3", "heloc", D("90000.00"), D("60000.00"), False, True),
                      (1, "4", "heloc", D("40000.00"), D("20000.00"), False, True)],
        "valuations": [(1, "1", "comp", D("500000.00"), AS_OF), (1, "2", "assessed", D("300000.00"), AS_OF)],
        "foreclosure": [(1, "nts", D("100000.00"), True, date(2026, 9, 1), 0, 0)],
    }


def build(spark, rows):
    schemas = {"core": CORE, "liens": LIENS, "mortgages": MORTGAGES, "valuations": VALUES, "foreclosure": FORECLOSURE}
    return portfolio(spark, **{name: spark.createDataFrame(values, schemas[name]) for name, values in rows.items()})


def arms():
    """(flag, accept, reject): the two records of a disputed value, as changes of the rows."""
    def change(name, seq, **fields):
        names = [part.split()[0] for part in {"liens": LIENS, "mortgages": MORTGAGES}[name].split(", ")]

        def apply(rows):
            rows[name] = [tuple(fields.get(column, value) for column, value in zip(names, row)) if row[1] == seq else row
                          for row in rows[name]]
        return apply

    def keep(seq):
        return lambda rows: rows.update(valuations=[row for row in rows["valuations"] if row[1] == seq])

    def no_bid(rows):
        rows["foreclosure"] = [(*row[:2], None, *row[3:]) for row in rows["foreclosure"]]

    recorded, released = {"attachment_basis": "recorded_against_property"}, {"status": "released"}
    return [
        (("lien_attachment", "1"), change("liens", "1", **recorded), change("liens", "1", **released)),
        (("missing_lien_amount", "2"), change("liens", "2", amount=D("4500.00")), change("liens", "2", **released)),
        (("missing_lien_amount", "3"), change("liens", "3", amount=D("12000.00")), change("liens", "3", **released)),
        (("conflicting_mortgage", "1"), change("mortgages", "2", is_open=False), change("mortgages", "1", is_open=False)),
        (("conflicting_mortgage", "heloc"), change("mortgages", "4", is_open=False), change("mortgages", "3", is_open=False)),
        (("valuation_dispersion", None), keep("1"), keep("2")),
        (("bid_mismatch", None), lambda rows: None, no_bid),
    ]


def test_impacts_equal_underwriting_both_arms(spark):
    wanted, variants = {}, {name: [] for name in tables()}
    cases = arms()
    for at, (_flag, accept, reject) in enumerate(cases):
        for side, mutate in enumerate((accept, reject)):
            rows = tables()
            mutate(rows)
            for name, values in rows.items():
                variants[name] += [(10 + 2 * at + side, *row[1:]) for row in values]
    equity = {row.property_id: row.adjusted_equity for row in underwrite(build(spark, variants), Assumptions()).collect()
              if row.scenario == "expected"}
    for at, (flag, _accept, _reject) in enumerate(cases):
        wanted[flag] = abs(equity[10 + 2 * at] - equity[11 + 2 * at])
    got = {}
    for row in collect_flags(build(spark, tables()), Assumptions(), AS_OF).collect():
        key = (row.flag_type, row.subject if row.flag_type in ("lien_attachment", "missing_lien_amount", "conflicting_mortgage") else None)
        got[key] = row.impact
    assert {key: got[key] for key in wanted} == wanted


def test_new_flags_and_pages(spark):
    requests = collect_flags(build(spark, tables()), Assumptions(), AS_OF)
    none = requests.limit(0)
    first = new_flags(requests.unionByName(requests), none)
    assert first.count() == requests.select("dedupe_key").distinct().count()
    assert new_flags(requests, first).count() == 0
    impacts = [row.impact for row in list_flags(first, limit=3).collect()]
    assert len(impacts) == 3 and impacts == sorted(impacts, reverse=True)


def test_decisions(spark):
    flags = spark.createDataFrame([(1, 7, "x", "open", ["a"]), (2, 7, "x", "open", ["b"]), (3, 7, "x", "open", ["c"]), (4, 7, "x", "resolved", ["d"])],
                                  "flag_id long, property_id long, flag_type string, status string, fact_ids array<string>")
    decisions = spark.createDataFrame(
        [(1, "approve", None, None), (2, "reject", None, None), (3, "replace", "attributes.sqft", "1500"), (4, "approve", None, None),
         (9, "approve", None, None)], "flag_id long, action string, field_path string, value string") \
        .selectExpr("*", "'n' AS note", "'u' AS user_id", "TIMESTAMP'2026-01-01' AS decided_at")
    facts = spark.createDataFrame([("a", 7, True), ("b", 7, True), ("c", 7, True)], "fact_id string, property_id long, is_active boolean") \
        .selectExpr("*", "CAST(NULL AS DECIMAL(20,6)) AS value_parsed", "'report' AS source_kind")
    resolutions = spark.createDataFrame([("a", "auto"), ("b", "auto")], "winning_fact_id string, verification_state string")
    out = resolve_flags(flags, decisions, facts, resolutions)
    assert {row.flag_id: row.status for row in out["flags"].collect()} == {1: "resolved", 2: "resolved", 3: "resolved", 4: "resolved"}
    ledger = {row.fact_id: row for row in out["facts"].collect()}
    assert ledger["a"].is_active and not ledger["b"].is_active
    human = [row for row in ledger.values() if row.source_kind == "human"]
    assert len(human) == 1 and human[0].value_parsed == 1500
    assert {row.winning_fact_id: row.verification_state for row in out["resolutions"].collect()} == {"a": "human_verified", "b": "auto"}
    assert sorted((row.flag_id, row.refused_because) for row in out["refused"].collect()) == [(4, "already_resolved"), (9, "not_found")]
    assert out["history"].count() == 3 and out["recompute"].count() == 1


def test_change_events_of_one_property(spark):
    before, later = tables(), tables()
    later["liens"] = [later["liens"][0][:3] + (D("26000.00"),) + later["liens"][0][4:], later["liens"][1],
                      (1, "9", "judgment", D("1.00"), False, "active", "unknown", date(2020, 1, 1))]
    later["foreclosure"] = [(1, "nts", D("100000.00"), True, date(2026, 10, 1), 0, 0)]
    later["valuations"] = [(1, "1", "comp", D("700000.00"), AS_OF)]
    weighted = [tuple(row) for row in later["valuations"]]
    events = detect_changes(build(spark, before), build(spark, {**later, "valuations": weighted})).collect()
    got = sorted((row.change_type, row.field_path, row.old_value, row.new_value) for row in events)
    assert ("lien_amount_corrected", "liens[judgment].amount", "25000.00", "26000.00") in got
    assert ("lien_released", "liens[mechanics]", None, None) in got
    assert ("new_lien", "liens[judgment]", None, "1.00") in got
    assert ("sale_date_moved", "foreclosure.current_sale_date", "2026-09-01", "2026-10-01") in got
    assert len(got) == 4
    assert detect_changes(build(spark, before), build(spark, before)).count() == 0
