"""Reports to extraction units: pages, scan test, classification, sections, token and cost estimates, budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.sql import text
from parcelscope.functions.text import token_estimate
from parcelscope.operators.ranking import running_totals

PAGE_BLOCK = 4096


@dataclass(frozen=True)
class Signature:
    pattern: str
    report_type: str
    vendor: str | None = None
    priority: int = 0


# Signatures used when the signature table is empty.
DEFAULT_SIGNATURES = (
    Signature("foreclosure|notice of trustee|NOD|NTS", "foreclosure"),
    Signature("mortgage|deed of trust", "mortgage"),
    Signature("lien|judgment", "lien"),
    Signature("bankruptcy|chapter 7|chapter 13", "bankruptcy"),
    Signature("comparables|comparative market", "comparables"),
    Signature("tax information|assessed value", "tax"),
    Signature("listing history|MLS", "listing_history"),
    Signature("owner information|ownership", "owner_report"),
)

# Header patterns of a section, the first matching one names it.
SECTION_HEADERS = {
    "mortgage": "mortgage|deed of trust",
    "foreclosure": "foreclosure|notice of trustee",
    "lien": "lien|judgment",
    "bankruptcy": "bankruptcy|chapter (7|11|13)",
    "tax": "tax information|assessed value",
    "comparables": "comparables|comparative market|comparable sales",
    "owner_report": "owner information|ownership",
}

# Schema name of a unit type, unit types that need the stronger model, prices per million tokens.
UNIT_ALIASES = {"mortgage": "mortgages", "lien": "liens", "owner_report": "ownership", "combined": "property_core"}
FRONTIER_UNITS = ("liens", "mortgages", "foreclosure", "bankruptcy")
KNOWN_UNITS = ("property_core", "ownership", "mortgages", "foreclosure", "bankruptcy", "valuation", "comparables",
               "listings", "tax", "rental", "condition_signals", "liens")
MODEL_PRICES = {"gpt-4o-mini": ("0.15", "0.60"), "gpt-4o": ("2.50", "10.00")}
FALLBACK_PRICE = ("2.50", "10.00")
CHEAP_MODEL, FRONTIER_MODEL = "gpt-4o-mini", "gpt-4o"
INPUT_TOKEN_PRICE, OUTPUT_TOKEN_PRICE, BATCH_PRICE_PER_1K = "0.0000025", "0.00001", "0.003"


def split_pages(reports: DataFrame) -> DataFrame:
    """Pages (report_id, page_number, text) of report texts, cut at form feeds and numbered from one."""
    return reports.where("length(text) > 0").select(
        "report_id", F.posexplode(F.split("text", "\f")).alias("at", "text")) \
        .select("report_id", (F.col("at") + 1).alias("page_number"), "text")


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR text of a page when it is not blank, else the extracted text; pages without OCR stay."""
    read = ocr.select("report_id", "page_number", F.col("text").alias("ocr_text"))
    return pages.join(read, ["report_id", "page_number"], "left").select(
        "report_id", "page_number", F.expr("CASE WHEN trim(ocr_text) <> '' THEN ocr_text ELSE text END").alias("text"))


def scanned_reports(pages: DataFrame) -> DataFrame:
    """Reports whose lower median of page lengths is under 100 or with more than 40 percent empty pages."""
    sized = pages.select("report_id", F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("size"))
    return sized.groupBy("report_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size) AS median_size"),
        F.count_if(F.col("size") == 0).alias("empty_pages"), F.count("*").alias("pages")) \
        .withColumn("is_scanned", F.expr("median_size < 100 OR empty_pages > pages * 0.4"))


def classify(pages: DataFrame, signatures: Sequence[Signature] = DEFAULT_SIGNATURES,
             names: DataFrame | None = None) -> DataFrame:
    """Type of every report: the signature that hits most pages, then higher priority, then earlier in the list.

    Signatures are constants of the plan. A page yields only the signatures that hit it, so what is exchanged grows
    with the hits, and hits are counted before the exchange. A file name counts as part of page one.
    """
    if not signatures:
        raise ValueError("at least one signature is needed")
    if names is not None:
        pages = pages.join(names.select("report_id", "file_name"), "report_id", "left").withColumn(
            "text", F.expr("CASE WHEN page_number = 1 AND file_name <> '' THEN concat(file_name, '\\n', text) ELSE text END"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){signature.pattern}"), F.lit(at))
                                     for at, signature in enumerate(signatures)]))
    per_page = pages.select("report_id", "page_number", F.explode(hits).alias("at"))
    counted = per_page.groupBy("report_id", "at").agg(
        F.count("*").alias("hits"), F.bool_or(F.col("page_number") == 1).alias("on_first"))

    def table(field: str, kind: str):
        cells = ", ".join(f"CAST({'NULL' if getattr(s, field) is None else text(getattr(s, field))} AS {kind})"
                          for s in signatures)
        return f"get(array({cells}), at)"

    best = counted.selectExpr("report_id", "hits", "on_first", "at", f"{table('priority', 'INT')} AS priority").groupBy(
        "report_id").agg(F.expr("max(struct(hits, priority, -at AS place, at, on_first)) AS b")).select("report_id", "b.*")
    sizes = pages.groupBy("report_id").agg(F.count("*").alias("pages"))
    rate = "(CAST(hits AS DOUBLE) / pages)"
    return sizes.join(best, "report_id", "left").selectExpr(
        "report_id", f"coalesce({table('report_type', 'STRING')}, 'unknown') AS report_type",
        f"{table('vendor', 'STRING')} AS vendor",
        f"""CASE WHEN hits IS NULL THEN 0D ELSE
            bround(least(0.95D, 0.5D + 0.4D * {rate} + CASE WHEN on_first THEN 0.05D ELSE 0D END), 4) END AS confidence""", f"coalesce(bround({rate}, 4), 0D) AS match_rate")


def signature_hits(pages: DataFrame, signatures: Sequence[Signature] = DEFAULT_SIGNATURES) -> DataFrame:
    """Pages hit and match rate per report and signature, for signatures that hit at all."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){s.pattern}"), F.lit(s.report_type)) for s in signatures]))
    counted = pages.select("report_id", F.explode(hits).alias("report_type")).groupBy("report_id", "report_type").agg(
        F.count("*").alias("hits"))
    sizes = pages.groupBy("report_id").agg(F.count("*").alias("pages"))
    return counted.join(sizes, "report_id").withColumn("match_rate", F.expr("bround(CAST(hits AS DOUBLE) / pages, 4)"))


def page_headers(pages: DataFrame, headers: Mapping[str, str] | None = None) -> DataFrame:
    """Name of the first header pattern that occurs on a page, else null."""
    found = None
    for name, pattern in (headers or SECTION_HEADERS).items():
        hit = F.col("text").rlike(f"(?i){pattern}")
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return pages.withColumn("header", found)


def _current_header(pages: DataFrame) -> DataFrame:
    """Latest header page at or before every page.

    Pages are cut into blocks: the last header of every block is carried over the few blocks of a report, then only
    looked up inside the block. A report of very many pages is spread over its blocks.
    """
    rows = pages.withColumn("block", F.expr(f"CAST(floor((page_number - 1) / {PAGE_BLOCK}) AS BIGINT)"))
    mark = F.when(F.col("header").isNotNull(), F.struct("page_number", "header"))
    blocks = rows.groupBy("report_id", "block").agg(F.max(mark).alias("last_"))
    earlier = Window.partitionBy("report_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("report_id", "block", F.max("last_").over(earlier).alias("carried"))
    inside = Window.partitionBy("report_id", "block").orderBy("page_number") \
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("own", F.max(mark).over(inside)).join(carried, ["report_id", "block"])
    return seen.withColumn("opened", F.coalesce("own", "carried")).drop("own", "carried", "block")


def section(pages: DataFrame, headers: Mapping[str, str] | None = None, size: int = 3, overlap: int = 1) -> DataFrame:
    """Extraction units of every report.

    A unit opens on a header page and lasts to the next one; pages before the first header belong to none. A report
    without headers is read in overlapping windows of pages; a page names its windows by arithmetic, without a join.
    """
    step = max(1, size - overlap)
    marked = page_headers(pages, headers)
    opened = _current_header(marked)
    by_header = opened.where("opened IS NOT NULL").selectExpr(
        "report_id", "opened.header AS unit_type", "opened.page_number AS page_start", "page_number", "text",
        "true AS matched_header")
    sizes = marked.groupBy("report_id").agg(F.count("*").alias("n"), F.count("header").alias("header_pages"))
    plain = pages.join(sizes.where("header_pages = 0").select("report_id", "n"), "report_id")
    # Window w holds pages w * step + 1 .. w * step + size; the last window is the first to reach the last page.
    first, last = f"greatest(0, CAST(ceil((page_number - {size}) / {step}) AS INT))", f"CAST(floor((page_number - 1) / {step}) AS INT)"
    last_window = f"greatest(0, CAST(ceil((n - {size}) / {step}) AS INT))"
    windows = plain.selectExpr("report_id", "page_number", "text", "n", f"explode(sequence({first}, {last})) AS w")
    windows = windows.where(f"w <= {last_window}").selectExpr(
        "report_id", "'combined' AS unit_type", f"w * {step} + 1 AS page_start", "page_number", "text", "false AS matched_header")
    return by_header.unionByName(windows).groupBy("report_id", "unit_type", "page_start", "matched_header").agg(
        F.max("page_number").alias("page_end"),
        F.expr("array_join(transform(array_sort(collect_list(struct(page_number, text))), p -> p.text), '\\n') AS text")) \
        .withColumn("token_estimate", token_estimate(F.col("text")))


def section_match_rate(units: DataFrame) -> DataFrame:
    """Share of pages in units opened by a header."""
    span = F.col("page_end") - F.col("page_start") + 1
    return units.groupBy("report_id").agg(
        F.sum(F.when(F.col("matched_header"), span).otherwise(0)).alias("matched"), F.sum(span).alias("total")) \
        .select("report_id", F.expr("bround(CAST(matched AS DOUBLE) / total, 4)").alias("match_rate"))


def unit_costs(units: DataFrame) -> DataFrame:
    """Estimated cost and model of every unit."""
    tokens = "coalesce(nullif(token_estimate, 0), CAST(floor(length(text) / 4) AS INT))"
    aliases = ", ".join(f"'{name}', '{schema}'" for name, schema in UNIT_ALIASES.items())
    name = f"coalesce(try_element_at(map({aliases}), unit_type), unit_type)"
    frontier = (f"unit_type = 'combined' OR {name} IN {tuple(FRONTIER_UNITS)} OR NOT {name} IN {tuple(KNOWN_UNITS)}")
    return units.withColumn("tokens", F.expr(tokens)).withColumn("cost_usd", F.expr(f"""
        CAST(bround(greatest(0.000001, tokens * {INPUT_TOKEN_PRICE} + CAST(floor(tokens / 4) AS INT) * {OUTPUT_TOKEN_PRICE}), 6)
             AS DECIMAL(14,6))""")).withColumn(
        "model", F.expr(f"CASE WHEN {frontier} THEN '{FRONTIER_MODEL}' ELSE '{CHEAP_MODEL}' END"))


def usage_costs(usage: DataFrame) -> DataFrame:
    """Cost of recorded calls (model, prompt_tokens, completion_tokens) by the price of the model."""
    def price(at: int) -> str:
        arms = " ".join(f"WHEN '{model}' THEN {prices[at]}" for model, prices in MODEL_PRICES.items())
        return f"CASE model {arms} ELSE {FALLBACK_PRICE[at]} END"

    cost = f"(coalesce(prompt_tokens, 0) * {price(0)} + coalesce(completion_tokens, 0) * {price(1)}) / 1000000"
    return usage.withColumn("cost_usd", F.expr(f"CAST(bround({cost}, 6) AS DECIMAL(14,6))"))


def budget_gate(units: DataFrame, limits: DataFrame) -> DataFrame:
    """Units a batch can afford in arrival order; the first unit over the limit pauses the batch and all after it.

    ``units`` has batch_id, unit_id, arrival and cost_usd; ``limits`` batch_id, spent_usd and budget_limit_usd (null is
    unlimited). Costs are not negative, so the running total decides, and it is taken over distributed ranges.
    """
    totals = running_totals(units, ["batch_id"], [F.col("arrival").asc(), F.col("unit_id").asc()], "cost_usd", "running")
    return totals.join(limits, "batch_id", "left").selectExpr(
        "batch_id", "unit_id", "cost_usd", "CAST(coalesce(spent_usd, 0) + running AS DECIMAL(22,8)) AS spent_after",
        "CASE WHEN budget_limit_usd IS NULL OR coalesce(spent_usd, 0) + running <= budget_limit_usd THEN 'accepted' "
        "ELSE 'paused' END AS decision")


def batch_estimates(units: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Reports, tokens and price of every batch, and whether it has to be confirmed."""
    sums = units.groupBy("batch_id").agg(F.countDistinct("report_id").alias("report_count"),
                                         F.sum("token_estimate").alias("total_tokens"))
    cost = f"CAST(bround(total_tokens / 1000 * {BATCH_PRICE_PER_1K}, 2) AS DECIMAL(14,2))"
    out = sums.withColumn("estimated_cost_usd", F.expr(cost))
    if limits is None:
        return out
    return out.join(limits.select("batch_id", "budget_limit_usd"), "batch_id", "left").withColumn(
        "status", F.expr("CASE WHEN estimated_cost_usd > budget_limit_usd THEN 'awaiting_confirmation' ELSE 'extracting' END"))


def batch_progress(units: DataFrame) -> DataFrame:
    """Completed and failed units of every batch and the state that follows."""
    counts = units.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "extracted").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.withColumn("batch_status", F.expr("""CASE WHEN completed + failed < total THEN 'extracting'
        WHEN completed = 0 THEN 'failed' ELSE 'computing' END"""))


def outstanding_units(units: DataFrame) -> DataFrame:
    """Units of a property still queued or running."""
    return units.groupBy("property_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("outstanding"))
