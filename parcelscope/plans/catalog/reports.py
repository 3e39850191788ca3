"""Documents: pages, classification, sections, tokens, costs and budget over the driver texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelscope.functions.text import content_hash, folded, has_parcel_anchor, token_estimate
from parcelscope.operators import documents
from parcelscope.operators.documents import Signature
from parcelscope.plans.catalog import plain, query, step

# The invented prose has no property wording, so sections and signatures are keyed on its syllables.
HEADERS = {"mortgage": "heon|ouhe", "lien": "blet|ndre", "tax": "eaux|schau", "owner_report": "zzz"}
SIGNATURES = (Signature("tion|ment", "mortgage", "v1", 1), Signature("und |auf ", "lien", None, 2),
              Signature("THE [a-z]+ion", "tax", "v2", 2), Signature("que", "owner_report", None, 0))


def _pages(t):
    texts = t.source("documents").select(F.col("doc_id").alias("report_id"), F.regexp_replace("text", "\n", "\f").alias("text"))
    return documents.split_pages(texts)


step("o_pages", """
    SELECT doc_id AS report_id, generate_subscripts(p, 1) AS page_number, unnest(p) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE length(text) > 0)""")
step("o_page_headers", """
    SELECT *, CASE WHEN regexp_matches(text, '(?i)heon|ouhe') THEN 'mortgage' WHEN regexp_matches(text, '(?i)blet|ndre') THEN 'lien'
        WHEN regexp_matches(text, '(?i)eaux|schau') THEN 'tax' END AS header FROM o_pages""")
step("o_units", """
    SELECT report_id, arg_min(header, page_number) AS unit_type, min(page_number) AS page_start, max(page_number) AS page_end,
      true AS matched_header, string_agg(text, chr(10) ORDER BY page_number) AS text
    FROM (SELECT *, sum(CASE WHEN header IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY page_number) AS part
          FROM o_page_headers) WHERE part > 0 GROUP BY report_id, part
    UNION ALL SELECT report_id, 'combined', min(page_number), max(page_number), false, string_agg(text, chr(10) ORDER BY page_number)
    FROM (SELECT p.*, w FROM o_pages p JOIN (SELECT report_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 3) / 2.0) AS INT)))) AS w
            FROM (SELECT report_id, count(*) AS n FROM o_page_headers GROUP BY 1 HAVING count(header) = 0)) x
          ON x.report_id = p.report_id AND p.page_number BETWEEN 2 * w + 1 AND 2 * w + 3) GROUP BY report_id, w""")
TOKENS = """greatest(1, CAST(round_even(coalesce(list_sum(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'),
    lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN greatest(1.0, length(p) / 5.25) WHEN regexp_matches(p, '^[0-9]')
      THEN ceil(length(p) / 3.0) WHEN regexp_matches(p, '^[\\p{{L}}²³¹⁰⁴-⁹₀-₉]') THEN 1.0 ELSE 0.9 END)), 0)
    + len(regexp_extract_all({text}, '\\n+')) * 0.9, 0) AS BIGINT))"""
step("o_unit_tokens", f"SELECT *, {TOKENS.format(text='text')} AS tokens FROM o_units")


@query("SRC-2_page_split", "SRC-1", sql="SELECT report_id, CAST(page_number AS BIGINT) AS page_number, length(text) AS size FROM o_pages")
def page_split(t):
    return plain(_pages(t).select("report_id", "page_number", F.length("text").cast("bigint").alias("size")))


@query("DOC-7_ocr_merge", sql="""
    SELECT report_id, CAST(page_number AS BIGINT) AS page_number,
      length(CASE WHEN page_number % 3 = 0 AND page_number % 2 = 0 THEN text || ' ocr' ELSE text END) AS size FROM o_pages""")
def ocr_merge(t):
    pages = _pages(t)
    ocr = pages.where("page_number % 3 = 0").withColumn(
        "text", F.expr("CASE WHEN page_number % 2 = 0 THEN concat(text, ' ocr') ELSE '  ' END"))
    return plain(documents.merge_ocr(pages, ocr).select("report_id", "page_number", F.length("text").cast("bigint").alias("size")))


@query("AGG-9_scan_test", sql="""
    SELECT report_id, CAST(list_extract(list_sort(list(length(trim(text)))), (count(*) - 1) // 2 + 1) AS DOUBLE) AS median_size,
      count(*) FILTER (WHERE trim(text) = '') AS empty_pages, count(*) AS pages,
      list_extract(list_sort(list(length(trim(text)))), (count(*) - 1) // 2 + 1) < 100
        OR count(*) FILTER (WHERE trim(text) = '') > count(*) * 0.4 AS is_scanned FROM o_pages GROUP BY 1""")
def scan_test(t):
    return plain(documents.scanned_reports(_pages(t)).withColumn("median_size", F.col("median_size").cast("double")))


step("o_signature_hits", """
    SELECT report_id, place, kind, vendor, priority, count(*) AS hits, bool_or(page_number = 1) AS on_first FROM o_pages,
      (VALUES (0, '(?i)tion|ment', 'mortgage', 'v1', 1), (1, '(?i)und |auf ', 'lien', NULL, 2),
              (2, '(?i)THE [a-z]+ion', 'tax', 'v2', 2), (3, '(?i)que', 'owner_report', NULL, 0)) s(place, pattern, kind, vendor, priority)
    WHERE regexp_matches(text, pattern) GROUP BY ALL""")


@query("DOC-1_classification", "JOI-9 SRC-9", sql="""
    SELECT p.report_id, coalesce(h.kind, 'unknown') AS report_type, h.vendor,
      CASE WHEN hits IS NULL THEN 0 ELSE round_even(least(0.95, 0.5 + 0.4 * (CAST(hits AS DOUBLE) / n) + CASE WHEN on_first THEN 0.05 ELSE 0 END), 4) END AS confidence,
      coalesce(round_even(CAST(hits AS DOUBLE) / n, 4), 0) AS match_rate
    FROM (SELECT report_id, count(*) AS n FROM o_pages GROUP BY 1) p LEFT JOIN (SELECT * FROM o_signature_hits
      QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY hits DESC, priority DESC, place) = 1) h USING (report_id)""")
def classification(t):
    return plain(documents.classify(_pages(t), SIGNATURES))


@query("AGG-7_signature_hits", sql="""
    SELECT report_id, kind AS report_type, hits, n AS pages, round_even(CAST(hits AS DOUBLE) / n, 4) AS match_rate
    FROM o_signature_hits JOIN (SELECT report_id, count(*) AS n FROM o_pages GROUP BY 1) USING (report_id)""")
def signature_hits(t):
    return plain(documents.signature_hits(_pages(t), SIGNATURES))


@query("DOC-2_page_headers", sql="SELECT report_id, CAST(page_number AS BIGINT) AS page_number, header FROM o_page_headers")
def page_headers(t):
    return plain(documents.page_headers(_pages(t), HEADERS).select("report_id", "page_number", "header"))


@query("DOC-3_sections", "WIN-8 WIN-9 STR-15", sql="""
    SELECT report_id, unit_type, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end, matched_header,
      md5(text) AS text_hash, tokens AS token_estimate FROM o_unit_tokens""")
def sections(t):
    units = documents.section(_pages(t), HEADERS)
    return plain(units.select("report_id", "unit_type", "page_start", "page_end", "matched_header",
                              F.md5("text").alias("text_hash"), "token_estimate"))


@query("AGG-8_section_match_rate", sql="""
    SELECT report_id, round_even(sum(CASE WHEN matched_header THEN page_end - page_start + 1 ELSE 0 END)
      / CAST(sum(page_end - page_start + 1) AS DOUBLE), 4) AS match_rate FROM o_units GROUP BY 1""")
def match_rate(t):
    return plain(documents.section_match_rate(documents.section(_pages(t), HEADERS)))


@query("DOC-4_unit_costs", "DOC-5", sql="""
    SELECT report_id, unit_type, CAST(page_start AS BIGINT) AS page_start,
      CAST(round_even(greatest(0.000001, tokens * 0.0000025 + (tokens // 4) * 0.00001), 6) AS DOUBLE) AS cost_usd,
      CASE WHEN unit_type IN ('combined', 'mortgage', 'lien') THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS model FROM o_unit_tokens""")
def unit_costs(t):
    return plain(documents.unit_costs(documents.section(_pages(t), HEADERS)).select(
        "report_id", "unit_type", "page_start", "cost_usd", "model"))


step("o_text_tokens", f"SELECT doc_id, source, {TOKENS.format(text='text')} AS tokens FROM documents WHERE length(text) > 0")


@query("STR-15_token_estimates", sql="SELECT doc_id, tokens AS token_estimate FROM o_text_tokens")
def token_estimates(t):
    return plain(t.source("documents").select("doc_id", token_estimate(F.col("text")).alias("token_estimate")))


@query("AGG-5_batch_estimates", sql="""
    SELECT source AS batch_id, count(*) AS report_count, CAST(sum(tokens) AS BIGINT) AS total_tokens,
      CAST(round_even(sum(tokens) * 0.000003, 2) AS DOUBLE) AS estimated_cost_usd,
      CASE WHEN round_even(sum(tokens) * 0.000003, 2) > 0.05 THEN 'awaiting_confirmation' ELSE 'extracting' END AS status
    FROM o_text_tokens GROUP BY 1""")
def batch_estimates(t):
    units = t.source("documents").select(F.col("doc_id").alias("report_id"), F.col("source").alias("batch_id"),
                                         token_estimate(F.col("text")).alias("token_estimate"))
    limits = units.select("batch_id").distinct().withColumn("budget_limit_usd", F.lit("0.05").cast("decimal(14,2)"))
    return plain(documents.batch_estimates(units, limits).drop("budget_limit_usd"))


@query("AGG-6_batch_progress", sql="""
    SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'ingested') AS completed,
      count(*) FILTER (WHERE status = 'failed') AS failed,
      CASE WHEN count(*) FILTER (WHERE status = 'queued') > 0 THEN 'extracting'
           WHEN count(*) FILTER (WHERE status = 'ingested') = 0 THEN 'failed' ELSE 'computing' END AS batch_status
    FROM d_reports GROUP BY 1""")
def batch_progress(t):
    units = t.table("d_reports").selectExpr("batch_id", "CASE WHEN status = 'ingested' THEN 'extracted' ELSE status END AS status")
    return plain(documents.batch_progress(units))


@query("AGG-1_outstanding_units", "JOI-2", sql="""
    SELECT property_id, count(*) FILTER (WHERE status = 'queued') AS outstanding FROM d_reports GROUP BY 1""")
def outstanding(t):
    return plain(documents.outstanding_units(t.table("d_reports").select("property_id", "status")))


@query("DOC-6_budget_gate", sql="""
    SELECT batch_id, unit_id, CAST(cost AS DOUBLE) AS cost_usd, CAST(running AS DOUBLE) AS spent_after,
      CASE WHEN batch_id = 'src1' OR running <= 0.02 THEN 'accepted' ELSE 'paused' END AS decision
    FROM (SELECT *, sum(cost) OVER (PARTITION BY batch_id ORDER BY unit_id ROWS UNBOUNDED PRECEDING) AS running
          FROM (SELECT source AS batch_id, doc_id AS unit_id, CAST(n_chars AS DECIMAL(14,6)) * 0.0000025 AS cost FROM documents))""")
def budget_gate(t):
    units = t.source("documents").selectExpr("source AS batch_id", "doc_id AS unit_id", "doc_id AS arrival",
                                             "CAST(CAST(n_chars AS DECIMAL(14,6)) * 0.0000025 AS DECIMAL(20,7)) AS cost_usd")
    limits = units.select("batch_id").distinct().withColumn(
        "budget_limit_usd", F.expr("CASE WHEN batch_id <> 'src1' THEN 0.02 END")).withColumn("spent_usd", F.lit(0).cast("decimal(14,6)"))
    return plain(documents.budget_gate(units, limits))


@query("STR-16_text_validation", "STR-3 STR-17", sql="""
    SELECT item_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS folded_hash, sha256(text) AS content_hash,
      regexp_matches(text, '(?i)\\b(apn|parcel|lot\\s*\\w|tract|block\\s*\\w|subdivision|legal\\s+description|book\\s*\\w+|page\\s*\\w+|instrument|doc(?:ument)?\\s*(?:#|no|number)|\\d{2,}-\\d{2,}|\\d{2,5}\\s+\\w[\\w ]*\\b(?:st|ave|avenue|rd|road|blvd|dr|drive|ln|lane|ct|court|way|pl|place|ter|terrace)\\b)') AS has_anchor
    FROM benchmark""")
def text_validation(t):
    return plain(t.source("benchmark").select("item_id", F.md5(folded(F.col("text"))).alias("folded_hash"),
                                              content_hash(F.col("text")).alias("content_hash"),
                                              has_parcel_anchor(F.col("text")).alias("has_anchor")))
