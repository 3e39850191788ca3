"""Text rules: names, numbers in text, trigrams, token estimates and page grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelscope.functions.lookups import LENDER_ALIASES, literal_map

NUMBER = "decimal(28,8)"

# Fixed value: text that may be read as one number.
NUMBER_TEXT = r"^\(?\s*-?\s*\$?\s*[\d,]*\.?\d+\s*[kKmMbB]?\s*%?\s*\)?$"

# A figure without brackets, inner blanks or suffix that any decimal holds exactly; what a cast can read as a decimal.
PLAIN_NUMBER_TEXT = r"^-?\$?(?:\d[\d,]{0,12})?\d(?:\.\d{1,8})?%?\z"
DECIMAL_TEXT = r"^[\x00-\x20]*[+-]?[\p{Nd}.]+(?:[eE][+-]?\p{Nd}+)?[\x00-\x20]*$"

# What the last letter of a figure stands for.
SUFFIXES = {"k": 1000, "m": 1_000_000, "b": 1_000_000_000}

# Fixed value: a number literal inside running text.
NUMBER_LITERAL = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"

# Fixed value: wording that ties a lien to a parcel.
PARCEL_ANCHOR = (
    r"(?i)\b(apn|parcel|lot\s*\w|tract|block\s*\w|subdivision|legal\s+description"
    r"|book\s*\w+|page\s*\w+|instrument|doc(?:ument)?\s*(?:#|no|number)"
    r"|\d{2,}-\d{2,}"
    r"|\d{2,5}\s+\w[\w ]*\b(?:st|ave|avenue|rd|road|blvd|dr|drive|ln|lane|ct|court|way|pl|place|ter|terrace)\b)"
)

# Fixed values of the token estimate.
LETTERS_PER_TOKEN = 5.25
DIGITS_PER_TOKEN = 3
MARK_TOKENS = 0.9


def folded(text: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def has_parcel_anchor(snippet: Column) -> Column:
    return snippet.rlike(PARCEL_ANCHOR)


def normalised_name(name: Column) -> Column:
    """Upper case, every run of other characters as one blank; null when nothing is left."""
    kept = F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]+", " "))
    return F.when(kept != "", kept)


def canonical_lender(name: Column) -> Column:
    plain = normalised_name(name)
    return F.coalesce(F.try_element_at(literal_map(LENDER_ALIASES, "string", "string"), plain), plain)


def parsed_number(raw: Column) -> Column:
    """Number of a raw text with currency sign, separators, brackets for minus, k/m/b or a percent sign."""
    text = F.trim(raw)
    # Where the whole pattern holds, brackets stand at the ends only, and a minus comes once.
    bare = F.trim(F.translate(text, "()$,%", ""))
    negative = (text.startswith("(") & text.endswith(")")) | bare.startswith("-")
    unsigned = F.trim(F.regexp_replace(bare, r"^-", ""))
    factor = F.coalesce(F.try_element_at(literal_map(SUFFIXES, "string", "int"), F.lower(F.right(unsigned, F.lit(1)))), F.lit(1))
    digits = F.trim(F.regexp_replace(unsigned, r"[kKmMbB]$", ""))
    signed = digits.try_cast("decimal(22,8)") * F.when(negative, -factor).otherwise(factor).cast("decimal(10,0)")
    # Most texts are plain figures; they need no other step.
    return F.when(text.rlike(PLAIN_NUMBER_TEXT), F.translate(text, "$,%", "").try_cast(NUMBER)) \
            .when(text.rlike(NUMBER_TEXT), signed.cast(NUMBER))


def lenient_number(text: Column) -> Column:
    """Number of a text once blanks, separators and the currency sign are gone, else null."""
    bare = F.trim(F.translate(text, ",$", ""))
    # A cast that fails costs an exception inside, and most texts are words.
    return F.when(bare.rlike(DECIMAL_TEXT), bare.try_cast("decimal(20,6)"))


def parsed_boolean(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("true", "yes", "y", "1"), F.lit(True)) \
            .when(plain.isin("false", "no", "n", "0"), F.lit(False))


def numbers_in(text: Column) -> Column:
    """Every number literal of a text as (number, unread): one with too many digits for a decimal is kept as it is written."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_LITERAL), F.lit(0))

    def read(token: Column) -> Column:
        number = F.regexp_replace(token, r"[$,%]", "").try_cast(NUMBER)
        return F.struct(number.alias("number"), F.when(number.isNull(), token).alias("unread"))

    return F.transform(found, read)


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of every word, padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def pieces(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda start: F.substr(padded, start, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def similarity(left: Column, right: Column) -> Column:
    """Shared share of two trigram arrays; zero when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)) \
            .otherwise(shared / (F.size(left) + F.size(right) - shared))


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a text: words by length, digit runs by three, marks and line breaks at 0.9."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)[A-Za-z]+|\d+|[^\sA-Za-z\d]"), F.lit(0))

    def weight(piece: Column) -> Column:
        size = F.length(piece).cast("double")
        return F.when(piece.rlike("^[A-Za-z]"), F.greatest(F.lit(1.0), size / F.lit(LETTERS_PER_TOKEN))) \
                .when(piece.rlike(r"(?U)^\d"), F.ceil(size / F.lit(float(DIGITS_PER_TOKEN))).cast("double")) \
                .when(piece.rlike(r"^[\p{L}²³¹⁰⁴-⁹₀-₉]"), F.lit(1.0)) \
                .otherwise(F.lit(MARK_TOKENS))

    words = F.aggregate(pieces, F.lit(0.0), lambda total, piece: total + weight(piece))
    breaks = F.regexp_count(text, F.lit(r"\n+")).cast("double") * F.lit(MARK_TOKENS)
    total = F.greatest(F.lit(1), F.rint(words + breaks).cast("int"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(total)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
