"""Secret scans with DataFrame functions only.

Base spans come from three fixed patterns. The method adds spans: candidate strings are the maximal runs of a character class;
a window of fixed width slides over a candidate, its Shannon entropy follows from the counts of its characters, and a step
changes only the counts of the character that leaves and the one that enters. The windows at or above the class's threshold,
joined where they touch, are spans. Windows that overlap a filler (an allowed word or a repeat) don't count: candidates are cut at
fillers, and of the pieces those of one letter case or of digits only are no secrets. Base spans are never suppressed.

Spans are (kind, start, end) in code points, end exclusive. A null text is an empty one and has none; every row is worked on
alone, so repeated rows, ties and null ids need no rule, and only the id and text columns are read.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order that breaks ties, with the pattern and the least length (fixed values).
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of AKIA[A-Z0-9]+ with 20 or more characters
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ with 24 or more characters
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_VALUE = 6

#: Character classes of the method: name, candidate pattern, alphabet, window width, least entropy in bits.
CLASSES = (
    ("hex_entropy", r"[0-9a-fA-F]{16,}", "0123456789abcdefABCDEF", 16, 2.75),
    ("base64_entropy", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.85),
)
#: Pieces that are no secrets: one letter case or digits only, identifiers joined by marks. Fillers: examples, repeats.
PLAIN = r"^[a-z+/_=-]+$|^[A-Z+/_=-]+$|^[0-9+/_=-]+$"
FILLER = r"(?i:example|sample|placeholder|dummy|changeme|x{4,}|abcdef0?123(?:456789)?|0123456789)|(.)\1{7,}"
ALLOWED = f"{PLAIN}|{FILLER}"
#: Windows in one traversal of a candidate, bits of a count and counts in one integer of a window's counts.
STRETCH, COUNT_BITS, PACKED = 512, 5, 12
LOCATED = "array<struct<start:int,end:int,match:string>>"


def _located(text: Column, pattern: str, matches: Column) -> Column:
    """(start, end, match) of all matches: what ``split`` leaves between them gives the gaps."""
    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(LOCATED).alias("spans"))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches,
                       lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, add, lambda s: s["spans"])).otherwise(F.array().cast(LOCATED))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` reads it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entropy_spans(candidate: Column, alphabet: str, width: int, least: float) -> Column:
    """Joined windows of a candidate whose entropy is ``least`` or more, as (from, to) within it.

    The entropy of a window of w characters is log2(w) - sum(c * log2 c) / w, so a threshold on the entropy is one on the sum.
    A window's counts are packed into a few integers, so a step changes one count of each of two of them whatever the alphabet.
    The candidate is traversed in stretches of ``STRETCH`` windows: a stretch's list of spans stays short, and time is linear.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)))
    limit = width * (math.log2(width) - least) + 1e-9
    # A character's place among the counts: its integer times 64, plus its bit.
    places = F.array(*(F.lit(i // PACKED * 64 + i % PACKED * COUNT_BITS) for i in range(len(alphabet))))
    words = [f"counts{i}" for i in range(-(-len(alphabet) // PACKED))]

    def word(place: Column) -> Column:
        return F.shiftright(place, 6)

    def bit(place: Column) -> Column:
        return place.bitwiseAND(F.lit(63))

    def one(place: Column, i: int) -> Column:
        return F.when(word(place) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit(place))).otherwise(F.lit(0).cast("long"))

    def count(state: Column, place: Column) -> Column:
        counts = F.get(F.array(*(state[w] for w in words)), word(place))
        return F.call_function("shiftright", counts, bit(place)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def step(state: Column, item: Column) -> Column:
        enters, leaves = item["enters"], item["leaves"]
        more, less = count(state, enters), count(state, leaves)
        total = state["sum"] + F.when(enters == leaves, F.lit(0.0)).otherwise(
            F.get(weight, more + 1) - F.get(weight, more)
            + F.when(leaves >= 0, F.get(weight, less - 1) - F.get(weight, less)).otherwise(0.0))
        found, to = state["found"], state["to"] + 1
        last, begin = F.get(found, F.size(found) - 1), to - width
        joins = F.coalesce(last["to"] >= begin, F.lit(False))
        window = F.array(F.struct(F.when(joins, last["from"]).otherwise(begin).alias("from"), to.alias("to")))
        kept = F.when(joins, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
        return F.struct(
            *((state[w] + one(enters, i) - F.when(leaves >= 0, one(leaves, i)).otherwise(F.lit(0).cast("long"))).alias(w)
              for i, w in enumerate(words)),
            total.alias("sum"), to.alias("to"),
            F.when((begin >= state["first"]) & (total <= limit), F.concat(kept, window)).otherwise(found).alias("found"),
            state["first"].alias("first"))

    def traversed(chars: Column, first: Column) -> Column:
        start = F.struct(*(F.lit(0).cast("long").alias(w) for w in words), F.lit(0.0).alias("sum"), first.alias("to"),
                         F.array().cast("array<struct<from:int,to:int>>").alias("found"), first.alias("first"))

        def stretch(part: Column) -> Column:
            left = F.concat(F.array_repeat(F.lit(-1), width), F.slice(part, F.lit(1), F.size(part) - width))
            items = F.zip_with(part, left, lambda c, gone: F.struct(c.alias("enters"), gone.alias("leaves")))
            return F.aggregate(items, start, step, lambda state: state["found"])

        return _bound(F.slice(chars, first + 1, F.lit(STRETCH + width - 1)), stretch)

    def spans(chars: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(chars) - width, F.lit(STRETCH))
        return _bound(F.flatten(F.transform(firsts, lambda first: traversed(chars, first))), joined_at_edges)

    def joined_at_edges(found: Column) -> Column:
        begins = F.filter(found, lambda s, i: (i == 0) | (F.get(found, i - 1)["to"] < s["from"]))
        ends = F.filter(found, lambda s, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["from"] > s["to"]))
        return F.zip_with(begins, ends, lambda begin, end: F.struct(begin["from"].alias("from"), end["to"].alias("to")))

    chars = F.transform(F.regexp_extract_all(candidate, F.lit("."), F.lit(0)), lambda c: F.get(places, F.instr(F.lit(alphabet), c) - 1))
    return _bound(chars, spans)


def _as_spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _pieces(candidate: Column) -> Column:
    """(start, match) of what is left of a candidate between its fillers."""
    def add(state: Column, pair: Column) -> Column:
        return F.struct(
            (state["at"] + F.length(pair["gap"]) + F.coalesce(F.length(pair["filler"]), F.lit(0))).alias("at"),
            F.concat(state["pieces"], F.array(F.struct(state["at"].alias("start"), pair["gap"].alias("match")))).alias("pieces"))

    match = candidate["match"]
    start = F.struct(candidate["start"].alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("pieces"))
    # The last gap has no filler after it.
    pairs = F.zip_with(F.split(match, FILLER, -1), F.regexp_extract_all(match, F.lit(FILLER), F.lit(0)),
                       lambda gap, filler: F.struct(gap.alias("gap"), filler.alias("filler")))
    whole = F.array(F.struct(candidate["start"].alias("start"), match.alias("match")))
    return F.when(match.rlike(FILLER), F.aggregate(pairs, start, add, lambda s: s["pieces"])).otherwise(whole)


def _added(found: Column, kind: str, alphabet: str, width: int, least: float, rank: int) -> Column:
    pieces = F.flatten(F.transform(found, _pieces))
    doubtful = F.filter(pieces, lambda c: (F.length(c["match"]) >= width) & ~c["match"].rlike(PLAIN))
    return F.flatten(F.transform(doubtful, lambda c: F.transform(
        _entropy_spans(c["match"], alphabet, width, least),
        lambda w: F.struct((c["start"] + w["from"]).alias("start"), F.lit(rank).alias("rank"),
                           (c["start"] + w["to"]).alias("end"), F.lit(kind).alias("kind")))))


def _spanned(rows: DataFrame, text: Column) -> DataFrame:
    """The rows with ``base`` and ``spans``; each step's columns are used by the next one, so none is computed twice."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {name: p for name, p, *_ in CLASSES}
    rows = rows.withColumn("scanned", F.coalesce(text, F.lit("")))
    rows = rows.withColumns({f"of_{k}": F.regexp_extract_all("scanned", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    rows = rows.withColumns({f"at_{k}": _located(F.col("scanned"), p, F.col(f"of_{k}")) for k, p in patterns.items()})
    valued = F.filter("at_assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= ASSIGN_VALUE)
    rows = rows.withColumn("base", F.array_sort(F.concat(
        _as_spans(valued, "assign", 0), _as_spans(F.col("at_access"), "access", 1), _as_spans(F.col("at_hex"), "hex", 2))))
    added = [_added(F.col(f"at_{name}"), name, alphabet, width, least, rank)
             for rank, (name, _, alphabet, width, least) in enumerate(CLASSES, len(BASE_KINDS))]
    return rows.withColumn("spans", F.array_sort(F.concat("base", *added)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, rank, end, kind) by start, then kind as listed; ``spans`` has the added ones too."""
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("read"))
    return _spanned(rows, F.col("read")).select(F.col("row.id").alias(id_col), "base", "spans")


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, every span of the text (overlapping ones joined) replaced by the mark; a null text stays null."""
    text = F.col("row")[text_col]

    def add(state: Column, span: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(span["start"] >= state["at"], F.concat(state["out"], kept, F.lit(mark)))
                        .otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rows = _spanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), text)
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate(
        "spans", start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))
    return rows.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(id_col, *(count(k) for k in BASE_KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                          joined(F.col("spans")).alias("spans"))

