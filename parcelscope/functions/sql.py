"""Short builders for SQL expression text: exact decimals, one rounding per labelled step.

The row-local arithmetic of the deal operators is written as SQL text for ``selectExpr``; later columns may
name earlier ones, so a whole block of figures is one projection.
"""

from __future__ import annotations

from decimal import Decimal

from parcelscope.functions.lookups import (
    FIRST_RATE_YEAR,
    LAST_RATE_YEAR,
    LOAN_TYPE_SPREAD,
    POSITION_WORDS,
    YEARLY_MORTGAGE_RATE,
)


def number(value, type_: str = "DECIMAL(12,6)") -> str:
    return f"CAST({'NULL' if value is None else Decimal(str(value))} AS {type_})"


def text(value: str) -> str:
    return "'" + str(value).replace("'", "\\'") + "'"


def money(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DECIMAL(16,2))"


def ratio(x: str) -> str:
    return f"CAST(ROUND({x}, 6) AS DECIMAL(12,6))"


def four(x: str) -> str:
    return f"CAST(ROUND({x}, 4) AS DECIMAL(12,4))"


def quotient(a: str, b: str, a_type: str = "DECIMAL(18,2)", b_type: str = "DECIMAL(18,2)") -> str:
    """Quotient with at least twelve places; null when the divisor is zero."""
    return f"try_divide(CAST({a} AS {a_type}), CAST({b} AS {b_type}))"


def share(a: str, b: str) -> str:
    return ratio(quotient(a, b))


def nz(x: str) -> str:
    return f"coalesce({x}, 0.00)"


def clamp(x: str, low, high) -> str:
    """Cut to a range; a null stays null."""
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({low}, least({high}, {x})) END"


def one_if(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS DECIMAL(18,6))"


def one_of(values) -> str:
    return "(" + ", ".join(text(value) for value in values) + ")"


def table(values: dict, type_: str = "DECIMAL(12,6)") -> str:
    """A small constant map; the optimizer keeps it as one literal."""
    cells = []
    for key, value in values.items():
        cells.append(str(key) if isinstance(key, int) else text(key))
        cells.append(text(value) if type_ == "STRING" else number(value, type_))
    return f"map({', '.join(cells)})"


def lookup(values: dict, key: str, type_: str = "DECIMAL(12,6)") -> str:
    return f"try_element_at({table(values, type_)}, {key})" if values else f"CAST(NULL AS {type_})"


def unit_interval(x: str, low, high) -> str:
    """Position between two bounds, cut to 0..1 at six places; null counts as 0."""
    width = Decimal(str(high)) - Decimal(str(low))
    if width == 0:
        return number(0)
    scaled = quotient(f"({x}) - {Decimal(str(low))}", str(width), "DECIMAL(20,6)", "DECIMAL(16,6)")
    return f"coalesce({ratio(clamp(scaled, 0, 1))}, {number(0)})"


def calendar_months(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


def elapsed(x: str) -> str:
    """Never below zero; null stays null."""
    return f"CASE WHEN {x} < 0 THEN 0 ELSE {x} END"


def half_life(periods: str, half) -> str:
    return f"power(0.5D, CAST({periods} AS DOUBLE) / {float(half)}D)"


def historical_rate(year: str, loan_type: str) -> str:
    """Yearly average rate plus the spread of the loan type; years beyond the table use its nearest end."""
    base = lookup(YEARLY_MORTGAGE_RATE, f"greatest({FIRST_RATE_YEAR}, least({LAST_RATE_YEAR}, {year}))", "DECIMAL(7,6)")
    spread = lookup(LOAN_TYPE_SPREAD, loan_type, "DECIMAL(7,6)")
    return f"CAST({base} + coalesce({spread}, 0) AS DECIMAL(9,6))"


def amortised_balance(original: str, rate: str, term_months: str, origination: str, as_of: str,
                      loan_type: str) -> str:
    """Balance left on a level-payment loan, to the cent; null when amount or date is unknown."""
    term = f"coalesce(nullif({term_months}, 0), 360)"
    monthly = f"(CAST(coalesce(CAST({rate} AS DECIMAL(9,6)), {historical_rate(f'year({origination})', loan_type)}) " \
              f"AS DOUBLE) / 12D)"
    paid = calendar_months(origination, as_of)
    curve = f"(power(1D + {monthly}, {term}) - power(1D + {monthly}, {paid})) / " \
            f"nullif(power(1D + {monthly}, {term}) - 1D, 0D)"
    line = f"CAST({term} - {paid} AS DOUBLE) / {term}"
    left = f"CAST({original} AS DOUBLE) * CASE WHEN {monthly} = 0D THEN {line} ELSE {curve} END"
    return f"""CASE WHEN {original} IS NULL OR {origination} IS NULL OR {as_of} IS NULL THEN NULL
        WHEN {paid} <= 0 THEN {money(original)}
        WHEN {paid} >= {term} THEN CAST(0 AS DECIMAL(16,2))
        ELSE {money(f'CAST({left} AS DECIMAL(28,8))')} END"""


def yearly_debt_service(loan: str, rate: str, years: str) -> str:
    """Twelve level payments; nothing for no loan, a straight line for a zero rate."""
    monthly = f"(CAST({rate} AS DOUBLE) / 12D)"
    level = f"CAST({loan} AS DOUBLE) * 12D * {monthly} / (1D - power(1D + {monthly}, -12D * {years}))"
    return f"""CASE WHEN {loan} <= 0 THEN CAST(0 AS DECIMAL(16,2))
        WHEN {monthly} = 0D THEN {money(f'CAST(CAST({loan} AS DOUBLE) / {years} AS DECIMAL(28,8))')}
        ELSE {money(f'CAST({level} AS DECIMAL(28,8))')} END"""


def position(x: str) -> str:
    """first/1st to 1 and so on, else the digits in the text, else the text, else 1."""
    return f"""coalesce({lookup(POSITION_WORDS, f'lower(trim({x}))', 'STRING')},
        nullif(regexp_replace(lower({x}), '[^0-9]', ''), ''), nullif(trim({x}), ''), '1')"""
