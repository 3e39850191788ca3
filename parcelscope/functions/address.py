"""Address and parcel-number standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.lookups import DIRECTIONALS, STREET_SUFFIXES, UNIT_DESIGNATORS, literal_map


def apn_key(apn: Column, fips: Column) -> Column:
    """County code plus the letters and digits of the parcel number; null without a parcel number."""
    plain = F.upper(F.regexp_replace(apn, "[^A-Za-z0-9]", ""))
    return F.when(F.length(apn) > 0, F.concat(F.coalesce(fips, F.lit("")), plain))


def zip_prefix(zip_code: Column) -> Column:
    five = F.substring(F.trim(zip_code), 1, 5)
    return F.when(five != "", five)


def _swap(tokens: Column, values: dict) -> Column:
    table = literal_map(values, "string", "string")
    return F.transform(tokens, lambda token: F.coalesce(F.try_element_at(table, token), token))


def _is_suffix(token: Column) -> Column:
    return token.isin(*sorted(set(STREET_SUFFIXES.values())))


def with_address_parts(df: DataFrame, address: str, zip_code: str) -> DataFrame:
    """Add house_number, street, suffix, unit and zip5 of an address line.

    The work is laid out in layers of columns: each layer is evaluated once and named, where one nested expression would be
    copied into every field that uses it.
    """
    text = F.regexp_replace(F.upper(F.coalesce(F.col(address), F.lit(""))), "#", " UNIT ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9 ]", " "), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\bP O BOX\b", "PO BOX"), r"\bPOBOX\b", "PO BOX")
    rows = df.withColumn("zip_", zip_prefix(F.col(zip_code))).withColumn(
        "tokens_", F.filter(F.split(text, " "), lambda token: token != ""))

    designators = literal_map(UNIT_DESIGNATORS, "string", "string")
    tokens = F.col("tokens_")
    with_follower = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)) \
                     .otherwise(F.array().cast("array<int>"))
    marked = F.filter(with_follower, lambda at: F.try_element_at(designators, F.get(tokens, at - 1)).isNotNull())
    rows = rows.withColumn("at_", F.get(marked, F.lit(0)))
    at = F.col("at_")
    unit = F.when(at.isNotNull(), F.concat_ws(" ", F.try_element_at(designators, F.get(tokens, at - 1)), F.get(tokens, at)))
    rest = F.when(at.isNull(), tokens).otherwise(
        F.filter(tokens, lambda _token, index: (index != at - 1) & (index != at)))
    rows = rows.withColumns({"unit_": unit, "rest_": _swap(_swap(rest, DIRECTIONALS), STREET_SUFFIXES)})

    rest = F.col("rest_")
    first = F.get(rest, F.lit(0))
    rows = rows.withColumns({
        "is_box_": F.coalesce((first == "PO") & (F.get(rest, F.lit(1)) == "BOX"), F.lit(False)),
        "number_": F.when(first.rlike(r"^\d+[A-Z]?$"), first)})
    rows = rows.withColumn("street_", F.when(F.col("number_").isNotNull(), F.slice(
        rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest))
    street = F.col("street_")
    rows = rows.withColumn("last_", F.try_element_at(street, F.lit(-1)))
    rows = rows.withColumn("has_suffix_", F.coalesce((F.size(street) > 1) & _is_suffix(F.col("last_")), F.lit(False)))
    name = F.when(F.col("has_suffix_"), F.slice(street, F.lit(1), F.greatest(F.size(street) - 1, F.lit(0)))).otherwise(street)
    return rows.withColumns({
        "house_number": F.when(F.col("is_box_"), F.get(rest, F.lit(2))).otherwise(F.col("number_")),
        "street": F.when(F.col("is_box_"), F.lit("PO BOX")).otherwise(F.array_join(name, " ")),
        "suffix": F.when(~F.col("is_box_") & F.col("has_suffix_"), F.col("last_")).otherwise(F.lit("")),
        "unit": F.col("unit_"), "zip5": F.col("zip_"),
    }).drop("zip_", "tokens_", "at_", "unit_", "rest_", "is_box_", "number_", "street_", "last_", "has_suffix_")


def address_key() -> Column:
    """number|street|suffix|unit|zip5, absent parts empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(name), F.lit("")) for name in
                              ("house_number", "street", "suffix", "unit", "zip5")])


def street_portion(key: Column) -> Column:
    """Everything before the ZIP code."""
    return F.when(key.isNull(), F.lit("")).otherwise(F.regexp_replace(key, r"\|[^|]*$", ""))


def house_number(key: Column, line1: Column) -> Column:
    """First part of the key, else the leading number of the written line."""
    first = F.substring_index(key, "|", 1)
    written = F.upper(F.regexp_extract(line1, r"^\s*(\d+[A-Za-z]?)", 1))
    return F.coalesce(F.when(first != "", first), F.when(written != "", written))
