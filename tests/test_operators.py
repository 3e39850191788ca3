"""Identity, ranking, filters, documents, explanations, suggestions, streams and sinks on small inputs."""

import json
import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parcelscope.functions.address import address_key, with_address_parts
from parcelscope.functions.dates import iso_date
from parcelscope.functions.text import lenient_number, parsed_number, token_estimate
from parcelscope.operators import analyst, calibration, documents, extraction, identity, portfolio, ranking
from parcelscope.operators.assumptions import DEFAULT_SET, Assumptions, transfer_tax
from parcelscope.operators.documents import Signature
from parcelscope.operators.scoring import DEFAULT_CONFIG, merged_config
from parcelscope.sources import readers, writers
from parcelscope.streaming import jobs


@pytest.mark.parametrize("address,zip_code,key", [
    ("87 Willa Cather Rd", "30303", "87|WILLA CATHER|RD||30303"),
    (" 87  Willa   Cather  RD. ", "30303-9876", "87|WILLA CATHER|RD||30303"),
    ("615 Harborview Blvd #14", "98101", "615|HARBORVIEW|BLVD|UNIT 14|98101"),
    ("615 Harborview Boulevard Suite 14", "98101", "615|HARBORVIEW|BLVD|STE 14|98101"),
    ("42 9th Ave Fl 3", "10011", "42|9TH|AVE|FL 3|10011"),
    ("771 South Second Street", "60607", "771|S SECOND|ST||60607"),
    ("P.O. Box 77", None, "77|PO BOX|||"), ("4B Elm Ln", None, "4B|ELM|LN||"),
    ("910 Highway 12", None, "910|HWY 12|||"), ("", None, "||||"),
])
def test_address_keys(spark, address, zip_code, key):
    rows = spark.createDataFrame([(address, zip_code)], "address string, zip5 string")
    assert with_address_parts(rows, "address", "zip5").select(address_key()).first()[0] == key


def test_number_text_and_tokens(spark):
    cases = {"$1,234.50": D("1234.5"), "(1,200)": D(-1200), "1.2M": D(1200000), "-$5k": D(-5000), "12%": D(12), "abc": None, "": None}
    rows = spark.createDataFrame([(text,) for text in cases], "text string")
    assert {row[0]: row[1] for row in rows.select("text", parsed_number(F.col("text"))).collect()} == cases
    assert rows.sparkSession.range(1).select(token_estimate(F.lit("Hello, world 12345 ok\n\nX"))).first()[0] == 8


def test_odd_numbers_and_dates(spark):
    cases = {"470,": None, "$1,,0": D(10), "1,.5": D("1.5"), "(-5)": D(-5), "( 7 k )": D(-7000), "7 K": D(7000), "$-5": None, "1.123456789": D("1.12345679"),
             "99999999999999.5%": D("99999999999999.5"), "123456789012345": None, "5.": None, " -$12 ": D(-12), None: None}
    rows = spark.createDataFrame([(text,) for text in cases], "text string")
    assert {row[0]: row[1] for row in rows.select("text", parsed_number(F.col("text"))).collect()} == cases
    cases = {"1e3": D(1000), "+.5": D("0.5"), "5.": D(5), "$1,000": D(1000), "\t7\n": D(7), "٣": D(3), "901 Main St": None, "First": None, "1.2.3": None,
             "e5": None, "-": None, "": None, " ": None, "9" * 30: None, None: None}
    rows = spark.createDataFrame([(text,) for text in cases], "text string")
    assert {row[0]: row[1] for row in rows.select("text", lenient_number(F.col("text"))).collect()} == cases
    cases = {"2024-02-29": date(2024, 2, 29), "2023-02-29": None, "2024-2-29": None, "2024-02-29 ": None, "2024-02-29\n": None, " 2024-02-29": None, None: None}
    rows = spark.createDataFrame([(text,) for text in cases], "text string")
    assert {row[0]: row[1] for row in rows.select("text", iso_date(F.col("text"))).collect()} == cases


def test_best_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["maple", "mapple", "oak", "oaks", "river", "rivers", "street", "streets", "12", "121", "1212"]
    texts = [(rng.choice(["z1", "z2"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for _ in range(120)]
    rows = spark.createDataFrame(texts, "block string, text string")
    got = {(row.block, row.left_text, row.right_text) for row in identity.best_matches(rows, rows, 0.8).collect()}

    def grams(text):
        return {f"  {word} "[at:at + 3] for word in text.split() for at in range(len(word) + 1)}

    wanted = set()
    for block, left in set(texts):
        for other, right in set(texts):
            a, b = grams(left), grams(right)
            if block == other and len(a & b) / len(a | b) >= 0.8:
                wanted.add((block, left, right))
    assert got == wanted


def test_identity_rules(spark):
    known = spark.createDataFrame([
        (1, "10 Maple Valley Street", "111", "06", "90001", None), (2, "77 Oak Ave", None, "06", "90001", None),
        (3, "5 Gone St", None, "06", "90001", 1)],
        "property_id long, address string, apn string, fips string, zip5 string, merged_into_id long")
    incoming = spark.createDataFrame([
        (101, 1, "10 MAPLE VALLEY ST.", None, "06", "90001"),           # same address in other words
        (102, 2, "999 Elsewhere Rd", "1-1-1", "06", "90002"),            # same parcel number, other place
        (103, 3, "77 Oaks Ave", None, "06", "90001"),                     # close, same house number, below the merge threshold
        (104, 4, "8 Brand New Loop", "222", "06", "90003"), (105, 5, "8 brand new loop", None, "06", "90003"),
        (106, 6, "8 Brand New Lp", "222", "06", "90003"),                 # joins 104 by parcel number
        (107, 7, "9 Brand New Loop", "222", "06", "90003"),               # parcel number of 104, other house
        (108, 8, "5 Gone St", None, "06", "90001"),                       # the known one is merged away
    ], "report_id long, arrival long, address string, apn string, fips string, zip5 string")
    out = identity.resolve_identities(incoming, known)
    got = {row.report_id: (row.property_key, row.outcome) for row in out["assignments"].collect()}
    assert got[101] == ("property:1", "exact") and got[102] == ("new:102", "conflict")
    assert got[103][0] in ("property:2", "new:103")
    assert got[104] == ("new:104", "new") and got[105] == ("new:104", "exact") and got[106] == ("new:104", "exact")
    assert got[107] == ("new:107", "conflict") and got[108] == ("new:108", "new")
    created = {row.property_key: row.apn_key for row in out["created"].collect()}
    assert created["new:102"] is None and created["new:107"] is None and created["new:104"] == "06222"
    clashes = {(row.property_key, row.other_key) for row in out["flags"].where("flag_type = 'identity_conflict'").collect()}
    assert clashes == {("property:1", "new:102"), ("new:102", "property:1"), ("new:104", "new:107"), ("new:107", "new:104")}


def test_ranking_splits_equal_scores(spark):
    """A third of all rows share one score; positions are a permutation and ties go by id."""
    scores = spark.range(9000).selectExpr("id AS score_id", "id AS property_id",
                                          "CAST(CASE WHEN id % 3 = 0 THEN 45 ELSE id % 97 END AS DECIMAL(9,4)) AS overall",
                                          "TIMESTAMP'2026-01-01' AS computed_at", "CAST(array() AS ARRAY<STRING>) AS gates_applied")
    none = spark.createDataFrame([], ranking.RANKINGS)
    first = ranking.rank_scope(scores, none, "portfolio", None, datetime(2026, 1, 1))
    rows = {row.property_id: row.rank for row in first.collect()}
    assert sorted(rows.values()) == list(range(1, 9001))
    order = sorted(range(9000), key=lambda i: (-(45 if i % 3 == 0 else i % 97), i))
    assert [rows[i] for i in order[:50] + order[4000:4050]] == [*range(1, 51), *range(4001, 4051)]
    second = ranking.rank_scope(scores, first, "portfolio", None, datetime(2026, 1, 2))
    assert second.where("prev_rank <> rank").count() == 0


def test_filters_refuse_what_they_do_not_know():
    for clause in ({"field": "secret", "op": "eq", "value": 1}, {"field": "apn", "op": "like", "value": "x"},
                   {"field": "apn", "op": "in", "value": []}, {"field": "gut_rating", "op": "eq", "value": "many"},
                   {"field": "tags", "op": "eq", "value": "a"}, {"field": "lat", "op": "between", "value": ["1"]}):
        with pytest.raises(portfolio.FilterError):
            portfolio.criteria([clause])
    with pytest.raises(portfolio.FilterError):
        portfolio.parsed_sort("-tags")
    assert portfolio.parsed_sort(None) == ("created_at", True) and portfolio.parsed_sort("+address") == ("address_line1", False)


def test_sections_and_classes(spark):
    pages = spark.createDataFrame(
        [(1, 1, "cover"), (1, 2, "DEED OF TRUST"), (1, 3, "more"), (1, 4, "a Judgment here"), *[(2, n, f"p{n}") for n in range(1, 7)]],
        "report_id long, page_number int, text string")
    units = [(row.report_id, row.unit_type, row.page_start, row.page_end, row.text) for row in
             documents.section(pages).orderBy("report_id", "page_start").collect()]
    assert units == [(1, "mortgage", 2, 3, "DEED OF TRUST\nmore"), (1, "lien", 4, 4, "a Judgment here"), (2, "combined", 1, 3, "p1\np2\np3"),
                     (2, "combined", 3, 5, "p3\np4\np5"), (2, "combined", 5, 6, "p5\np6")]
    kinds = {row.report_id: (row.report_type, row.confidence) for row in documents.classify(pages).collect()}
    assert kinds == {1: ("mortgage", 0.6), 2: ("unknown", 0.0)}
    far = spark.createDataFrame([(3, 1, "lien"), (3, 9000, "x"), (3, 20000, "y")], "report_id long, page_number int, text string")
    assert [row.page_end for row in documents.section(far).collect()] == [20000]
    with pytest.raises(ValueError):
        documents.classify(pages, [])


def test_recorded_response(spark):
    item = {"lien_type": "federal_tax", "creditor_raw": "IRS", "amount_raw": "$48,210.50", "amount_parsed": 48210.5, "recording_date": "2022-03-14",
            "attachment_basis": "recorded_against_property", "page_number": 1, "snippet": "Recorded against APN 4821-003", "extraction_confidence": 0.97,
            "null_reason": None}
    loose = {**item, "attachment_basis": "recorded_against_property", "snippet": "John A Smith owes"}
    responses = spark.createDataFrame([(1, 1, "lien", json.dumps({"liens": [item, loose, {**item, "page_number": 0}]}))],
                                      "report_id long, unit_id long, unit_type string, response string")
    pages = spark.createDataFrame([(1, 1, "RECORDED  against\napn 4821-003 and John A Smith owes")], "report_id long, page_number int, text string")
    rows = extraction.validate(extraction.flatten(responses), pages, date(2026, 1, 1))
    got = {row.field_path: row for row in rows.where("field_path IS NOT NULL").collect()}
    assert got["liens[0].amount"].value_parsed == D("48210.5") and got["liens[0].amount"].is_active
    assert got["liens[0].recording_date"].value_date == date(2022, 3, 14)
    assert got["liens[0].attachment_basis"].value_text == "recorded_against_property"
    assert got["liens[1].attachment_basis"].value_text == "unknown" and got["liens[1].attachment_basis"].downgraded
    assert rows.where("outcome = 'schema_failed'").count() == 1
    gold = spark.createDataFrame([(1, "liens[0].amount", D("48210.5"), None, None), (1, "liens[0].lien_type", None, "hoa", None)],
                                 "report_id long, field_path string, value_parsed decimal(20,6), value_text string, value_date date")
    assert {row.field: (row.expected, row.matched) for row in extraction.grade(rows, gold).collect()} == {"liens[].amount": (1, 1), "liens[].lien_type": (1, 0)}


def test_explanation_text(spark):
    def score(property_id, overall, parts):
        return (property_id, *[D(v) for v in (overall, overall, "0", "0", "0")], {k: D(v) for k, v in parts.items()})

    scores = spark.createDataFrame([score(1, "50", {"fos_profit_norm": "0.5", "profit": "75000", "risk_liens": "12"}),
                                    score(2, "40", {"fos_profit_norm": "0.2", "profit": "30000", "risk_liens": "6"})],
                                   "property_id long, overall decimal(9,4), fos decimal(9,4), distress decimal(9,4), data_confidence decimal(9,4), "
                                   "risk decimal(9,4), components map<string,decimal(18,6)>")
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert analyst.explanations(pairs, scores).first().explanation == (
        "1 is 10.0 points above 2 overall (50.0 vs 40.0). Biggest drivers: Financial Opportunity: expected profit +0.3 pts "
        "($75,000 vs $30,000 expected profit). Partly offset by Risk: open lien count -6.0 pts.")


def test_many_signatures_and_sets(spark):
    table = spark.createDataFrame([(n, f"word{n}$", "lien", None, n, True) for n in range(600)],
                                  "id int, pattern string, report_type string, vendor string, priority int, is_active boolean")
    signatures = readers.load_signatures(table)
    assert len(signatures) == 600 and signatures[-1].pattern == "word0$"
    assert len(Assumptions([{**DEFAULT_SET, "id": str(n)} for n in range(100)]).ids) == 100


def test_finished_properties_are_told_once(spark, tmp_path):
    source, told = tmp_path / "increments", []
    rows = "property_id long, expected int, finished int"
    batches = [[(1, 2, 1), (2, 1, 1)], [(1, 0, 1), (2, 0, 0)], [(1, 1, 1), (3, 1, 0)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, rows).coalesce(1).write.parquet(str(source / str(n)))
        stream = spark.readStream.schema(rows).parquet(str(source / "*"))
        jobs.fan_in(stream, lambda df, epoch: told.extend(r.property_id for r in df.collect()), str(tmp_path / "checkpoint"))
    assert sorted(told) == [1, 2]


def test_suggestions_become_new_versions():
    changed = calibration.accept_suggestion(DEFAULT_SET, "repairs.psf_by_condition.moderate", "50.25", "new-id")
    assert changed["version"] == 2 and changed["repairs"]["psf_by_condition"]["moderate"] == "50.25"
    assert DEFAULT_SET["repairs"]["psf_by_condition"]["moderate"] == "42"
    with pytest.raises(ValueError):
        calibration.accept_suggestion(DEFAULT_SET, "nothing.here", 1, "x")
    config = calibration.accept_weights(DEFAULT_CONFIG, {"fos": "0.55"})
    assert config["version"] == 1 and DEFAULT_CONFIG["weights"]["overall"]["fos"] == "0.50"
    assert merged_config({"gates": {"dcs_cap": "50"}})["gates"] == {"dcs_cap_threshold": "40", "dcs_cap": "50", "dcs_low_threshold": "50"}


def test_repair_rate_converges(spark):
    deals = spark.range(20).selectExpr("'moderate' AS condition", "CAST((1000 + id * 50) * 42 AS DECIMAL(16,2)) AS predicted_repairs",
                                       "CAST((1000 + id * 50) * 60 AS DECIMAL(16,2)) AS actual_repairs")
    assert calibration.repair_costs(deals).first().suggested_psf == D("60.00")


def test_configuration_tables(spark):
    sets = spark.createDataFrame([("a", "one", 1, False, '{"resale": {"commission_pct": "0.06"}}'), ("b", "two", 3, True, "{}"), ("c", "three", 9, False, "{}")],
                                 "id string, name string, version int, is_default boolean, params string")
    assert readers.load_assumption_sets(sets)[0]["id"] == "b"
    assert readers.load_assumption_sets(sets, ["a"])[0]["resale"] == {"commission_pct": "0.06"}
    with pytest.raises(LookupError):
        readers.load_assumption_sets(sets, ["z"])
    configs = spark.createDataFrame([("x", 1, True, "{}", "{}", '{"nod": "20", "risk": {"lien_count": "7"}}', "{}"), ("y", 2, False, "{}", "{}", "{}", "{}")],
                                    "id string, version int, is_active boolean, weights string, bounds string, distress_points string, gates string")
    config = readers.load_scoring_config(configs)
    assert config["id"] == "x" and config["risk_points"] == {"lien_count": "7"} and config["distress_points"] == {"nod": "20"}
    signatures = spark.createDataFrame([(1, "good", "lien", None, 1, True), (2, "(bad", "lien", None, 5, True), (3, "off", "tax", None, 9, False)],
                                       "id int, pattern string, report_type string, vendor string, priority int, is_active boolean")
    assert readers.load_signatures(signatures) == [Signature("good", "lien", None, 1)]
    assert len(readers.load_signatures(signatures.where("id = 3"))) == 8
    keys = spark.createDataFrame([("ca:alameda",), ("wa",), (None,), ("zz",)], "k string").selectExpr(f"CAST({transfer_tax('k')} AS DOUBLE) AS r")
    assert [row.r for row in keys.collect()] == [0.0011, 0.0128, 0.0, 0.0]


def test_page_files_and_exports(spark, tmp_path):
    for name, text in (("r1/pages/1.txt", "one"), ("r1/pages/10.txt", "ten"), ("r2/pages/2.txt", "two")):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    pages = {(row.report, row.page_number): row.text for row in readers.read_page_files(spark, str(tmp_path / "docs")).collect()}
    assert pages == {("r1", 1): "one", ("r1", 10): "ten", ("r2", 2): "two"}
    with pytest.raises(ValueError):
        writers.export_csv(spark.range(1).selectExpr("id", "current_timestamp() AS created_at"), str(tmp_path / "x"), ["nope"])


def test_streams_equal_batches_and_survive_repeats(spark, tmp_path):
    units = spark.range(60).selectExpr("'b' AS batch_id", "id AS unit_id", "id AS arrival", "CAST(0.01 AS DECIMAL(20,7)) AS cost_usd")
    source = tmp_path / "units"
    units.where("unit_id < 30").coalesce(1).write.parquet(str(source / "a"))
    stream = spark.readStream.schema(units.schema).parquet(str(source / "*"))
    limits = spark.createDataFrame([("b", D("0.20"))], "batch_id string, budget_limit_usd decimal(14,2)")
    out, checkpoint = str(tmp_path / "budget"), str(tmp_path / "checkpoint")
    jobs.spend_budget(stream, limits, out, checkpoint)
    assert spark.read.parquet(f"{out}/accepted").count() == 20
    units.where("unit_id >= 30").coalesce(1).write.parquet(str(source / "b"))
    raised = limits.withColumn("budget_limit_usd", F.lit("0.45").cast("decimal(14,2)"))
    jobs.spend_budget(stream, raised, out, checkpoint)
    accepted = sorted(row.unit_id for row in spark.read.parquet(f"{out}/accepted").collect())
    assert accepted == list(range(45))


def test_intake_registers_a_content_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (inbox / "b.pdf").write_bytes(b"%PDF-1.4 one")
    (inbox / "c.pdf").write_bytes(b"not a report")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    jobs.take_in(jobs.inbox(spark, str(inbox)), out, checkpoint)
    (inbox / "d.pdf").write_bytes(b"%PDF-1.4 one")
    (inbox / "e.pdf").write_bytes(b"%PDF-1.4 two")
    jobs.take_in(jobs.inbox(spark, str(inbox)), out, checkpoint)
    assert spark.read.parquet(f"{out}/accepted").count() == 2
    assert spark.read.parquet(f"{out}/failed").count() == 1
