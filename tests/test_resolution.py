"""Resolution of small ledgers, agreement counts against all pairs, and a group that holds most facts."""

import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from parcelscope.operators import resolution
from parcelscope.schemas import FACTS

AS_OF = date(2026, 8, 1)


def fact(property_id, report, entity, local, path, **value):
    row = {"property_id": property_id, "report_id": report, "extraction_unit_id": report, "entity_type": entity,
           "entity_local_id": local, "field_path": path, "value_raw": None, "value_parsed": None, "value_text": None,
           "value_date": None, "value_bool": None, "unit": None, "as_of_date": AS_OF, "page_number": 1, "snippet": path,
           "extraction_confidence": D("0.9"), "null_reason": None, "source_kind": "report", "is_active": True}
    row.update(value)
    return row


def ledger(spark, rows):
    rows = [{"fact_id": f"f{at:04d}", **row} for at, row in enumerate(rows)]
    names = [part.split()[0] for part in FACTS.split(", ")]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], FACTS)


def mortgage(property_id, report, local, amount, day, lender="Wells Fargo Bank, N.A.", **more):
    rows = [fact(property_id, report, "mortgage", local, "mortgages.lender_name", value_text=lender),
            fact(property_id, report, "mortgage", local, "mortgages.position", value_text="First"),
            fact(property_id, report, "mortgage", local, "mortgages.loan_amount", value_parsed=D(amount)),
            fact(property_id, report, "mortgage", local, "mortgages.date", value_date=day),
            fact(property_id, report, "mortgage", local, "mortgages.interest_rate", value_parsed=D("6.5"))]
    return rows + [fact(property_id, report, "mortgage", local, f"mortgages.{name}", **value) for name, value in more.items()]


def test_worked_ledger(spark):
    rows = [
        *mortgage(1, 1, "m1", "240000", date(2017, 8, 1)),
        # The same loan in another report: name written differently, ten days later, amount half a percent off.
        *mortgage(1, 2, "m2", "241000", date(2017, 8, 10), lender="WELLS FARGO HOME MTG"),
        fact(1, 1, "property", "p", "property.apn", value_text="APN-1"),
        fact(1, 2, "property", "p", "property.apn", value_text="APN-2"),
        fact(1, 1, "property", "p", "property.address.line1", value_text="4 Main St"),
        fact(1, 1, "property", "p", "attributes.sqft", value_parsed=D("1400")),
        fact(1, 2, "property", "p", "attributes.sqft", value_parsed=D("1500"), source_kind="human", as_of_date=date(2001, 1, 1)),
        fact(1, 1, "valuation", "v1", "valuation.type", value_text="Comp"),
        fact(1, 1, "valuation", "v1", "valuation.estimate", value_parsed=D("350000")),
        fact(1, 2, "valuation", "v2", "valuation.type", value_text="AVM"),
        fact(1, 2, "valuation", "v2", "valuation.estimate", value_parsed=D("600000")),
        fact(1, 1, "lien", "l1", "liens.type", value_text="Judgment"),
        fact(1, 1, "lien", "l1", "liens.status", value_text="Active"),
        fact(1, 1, "foreclosure", "e1", "foreclosure.stage", value_text="NOD"),
        fact(1, 1, "foreclosure", "e1", "foreclosure.nod_date", value_date=date(2026, 1, 1)),
        fact(1, 1, "foreclosure", "e2", "foreclosure.stage", value_text="NTS"),
        fact(1, 1, "foreclosure", "e2", "foreclosure.nts_date", value_date=date(2026, 5, 1)),
        fact(1, 1, "condition", "c1", "condition.level", value_text="ruined"),
        fact(1, 1, "condition", "c2", "condition.level", value_text="Heavy"),
        fact(1, 1, "property", "p", "property.city", value_text="gone", is_active=False),
    ]
    out = resolution.resolve(ledger(spark, rows), AS_OF)
    p = out.portfolio
    loans = p.mortgages.collect()
    assert len(loans) == 1 and loans[0].position == "1" and loans[0].balance_method == "amortization_v1"
    # Equal scores: the higher liability wins.
    assert loans[0].original_amount == D("241000.00") and loans[0].rate == D("0.065000")
    core = p.core.collect()[0]
    assert core.sqft == 1500 and core.verified_field_count == 1 and core.condition == "heavy" and core.city is None
    assert core.has_gating_flag and core.title_flag_count == 1 and core.conflict_count == 2
    assert core.tracked["sqft"].source_kind == "human"
    assert p.foreclosure.collect()[0].stage == "nts" and p.foreclosure.collect()[0].is_active
    kinds = sorted(row.flag_type for row in out.flags.collect())
    assert kinds == ["identity_conflict", "missing_lien_amount", "valuation_dispersion"]


def brute_force(rows):
    out = {}
    for a in rows:
        n = 0
        for b in rows:
            if a["report_id"] == b["report_id"] or (a["source_kind"] == "human") != (b["source_kind"] == "human"):
                continue
            x, y = a["value_parsed"], b["value_parsed"]
            n += abs(x - y) <= D("0.02") * max(abs(x), abs(y))
        out[a["snippet"]] = n
    return out


def test_agreement_matches_all_pairs(spark):
    rng = random.Random(7)
    base = [D(100), D(98), D("97.99"), D(102), D("102.0408"), D("102.05"), D(0), D(-100), D(-98), D(50000), D(51000), D(49000)]
    rows = []
    for at in range(260):
        value = rng.choice(base) + D(rng.randrange(0, 40)) / 10 * rng.randrange(0, 2)
        rows.append(fact(1, rng.randrange(0, 60), "valuation", "v", "valuation.value", value_parsed=value, snippet=f"s{at}",
                         source_kind=rng.choice(["report", "report", "human"])))
    typed = resolution.typed_facts(ledger(spark, rows)).withColumn("entity_key", F.lit(""))
    got = {row.snippet: row.agreeing for row in resolution.agreement(typed).collect()}
    assert got == brute_force(rows)


def test_one_group_with_most_facts(spark):
    """A field stated in very many reports with one value: counted from copies, and every fact keeps its row."""
    facts = spark.range(20000).selectExpr(
        "CAST(id AS STRING) AS fact_id", "1L AS property_id", "id AS report_id", "'tax' AS entity_type", "'' AS local_id",
        "'annual_taxes' AS leaf", "'tax.annual_taxes' AS field_path", "'s' AS snippet", "CAST(4000 AS DECIMAL(20,6)) AS value_parsed",
        "CAST(4000 AS DECIMAL(20,6)) AS num", "'4000' AS txt", "CAST(NULL AS DATE) AS day", "CAST(NULL AS BOOLEAN) AS flag",
        "CAST(NULL AS BOOLEAN) AS stated_flag", "CAST(NULL AS STRING) AS stated_text", "'4000' AS value_raw", "CAST(NULL AS DATE) AS as_of",
        "CAST(0.9 AS DECIMAL(5,4)) AS confidence", "'report' AS kind", "false AS is_human", "true AS is_money", "'' AS entity_key")
    rows = resolution.scored(facts, AS_OF).agg(F.count("*").alias("n"), F.min("agreeing").alias("lo"), F.max("agreeing").alias("hi")).first()
    assert (rows.n, rows.lo, rows.hi) == (20000, 19999, 19999)


def test_winners_equal_a_sort_of_every_group(spark):
    """Precedence decides, then the texts; a group that holds a third of all facts, equal facts, people and entries without a key."""
    rng = random.Random(11)
    rows = []
    for at in range(600):
        property_id = 1 if at % 3 == 0 else rng.randrange(2, 40)
        leaf = rng.choice(["mortgages.current_balance", "valuation.estimate", "liens.type"])
        entity = {"m": "mortgage", "v": "valuation", "l": "lien"}[leaf[0]]
        value = {"value_text": rng.choice(["Judgment", "hoa"])} if entity == "lien" else {"value_parsed": D(rng.choice(["1000", "-2500.25", "99000000000000"]))}
        rows.append(fact(property_id, rng.randrange(1, 5), entity, rng.choice(["e1", "e2", None]), leaf, snippet=rng.choice("ab"),
                         source_kind=rng.choice(["report", "api", "human"]) if at % 7 == 0 else "report", **value))
    typed = resolution.typed_facts(ledger(spark, rows)).withColumn("entity_key", F.col("local_id"))
    scored = resolution.scored(typed, AS_OF)
    groups = {}
    for row in scored.collect():
        groups.setdefault((row.property_id, row.entity_type, row.entity_key, row.leaf), []).append(row)
    wanted = set()
    for key, own in groups.items():
        best = min(own, key=lambda r: tuple(r.w)[:7])
        rivals = sum(r.is_human for r in own) if best.is_human else len(own)
        wanted.add((*key, best.fact_id, best.score, rivals - 1, "human_verified" if best.is_human else "auto"))
    got = {tuple(row) for row in resolution.field_resolutions(scored).collect()}
    assert got == wanted and any(key[2] is None for key in groups)


def test_winners_do_not_sort_the_ledger(spark):
    rows = ledger(spark, [fact(1, 1, "property", "p", "property.apn", value_text="A")])
    scored = resolution.scored(resolution.typed_facts(rows).withColumn("entity_key", F.col("local_id")), AS_OF)
    plan = scored.groupBy(*resolution.GROUP[:-1]).agg(F.min("precedence"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_agreement_is_exact_at_the_border(spark):
    """Amounts above 100 billion with six decimals, one millionth inside, on and outside two percent, of either sign."""
    amounts = []
    for large in (D("123456789012.345650"), D("99999999999999.000050"), D("700000000001.000000"), D("50.000000")):
        edge = (large * 49 / 50).quantize(D("0.000001"))
        amounts += [sign * x for sign in (1, -1) for x in (large, edge - D("0.000002"), edge - D("0.000001"), edge, edge + D("0.000001"))]
    amounts += [D(0), amounts[0]]
    rows = [fact(1, at, "valuation", "v", "valuation.estimate", value_parsed=x) for at, x in enumerate(amounts)]
    typed = resolution.typed_facts(ledger(spark, rows)).withColumn("entity_key", F.col("local_id"))
    got = {row.report_id: row.agreeing for row in resolution.agreement(typed).collect()}
    wanted = {at: sum(i != at and abs(x - y) <= D("0.02") * max(abs(x), abs(y)) for i, y in enumerate(amounts)) for at, x in enumerate(amounts)}
    assert got == wanted


def test_a_table_is_made_from_its_own_kinds_and_is_the_same(spark):
    facts = ledger(spark, [
        *mortgage(1, 1, "m1", "240000", date(2017, 8, 1)), *mortgage(1, 2, "m2", "241000", date(2017, 8, 10), lender="WELLS FARGO HOME MTG"),
        *mortgage(2, 1, "m1", "90000", date(2015, 1, 1)),
        fact(1, 1, "property", "p", "property.apn", value_text="APN-1"),
        fact(1, 1, "valuation", "v1", "valuation.type", value_text="Comp"),
        fact(1, 1, "valuation", "v1", "valuation.estimate", value_parsed=D("350000")),
        fact(1, 1, "foreclosure", "e1", "foreclosure.stage", value_text="NOD"),
        fact(2, 2, "foreclosure", "e2", "foreclosure.nts_date", value_date=date(2026, 5, 1)),
        fact(2, 1, "listing", "s1", "listing.date", value_date=date(2026, 4, 1))])
    whole = resolution.resolve(facts, AS_OF)
    portfolio = whole.portfolio
    for name, kinds in (("mortgages", {"mortgage"}), ("foreclosure", {"foreclosure"}), ("listings", {"listing"})):
        alone = resolution.resolve(facts, AS_OF)
        rows = alone.record(name)
        assert list(alone._scored) == [frozenset(kinds)] and list(alone._tables) == [name]
        assert sorted(map(str, rows.collect())) == sorted(map(str, getattr(portfolio, name).collect())) != []
    alone = resolution.resolve(facts, AS_OF)
    assert sorted(alone.entries("mortgage").collect()) == sorted(whole.entries("mortgage").collect()) != []
    assert not alone._scored
