"""Fixed values that decide results, kept together and in natural order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(values: dict, key_type: str, value_type: str) -> Column:
    """A small constant map as a column; the optimizer folds it into the generated code."""
    if not values:
        return F.lit(None).cast(f"map<{key_type},{value_type}>")
    cells = []
    for key, value in values.items():
        cells.append(F.lit(key).cast(key_type))
        cells.append(F.lit(Decimal(str(value)) if value_type.startswith("decimal") else value).cast(value_type))
    return F.create_map(*cells)


# Enumerations of the data contract.
STRATEGIES = ("cash", "flip", "wholesale", "rental", "subject_to", "foreclosure")
CONDITION_LADDER = ("pristine", "cosmetic", "moderate", "heavy", "gut")
INACTIVE_LIEN_STATUSES = ("released", "satisfied")
UNRANKABLE_GATES = ("insufficient_data", "open_gating_flag")
GATING_FLAG_TYPES = ("identity_conflict",)

# Yearly average 30-year fixed mortgage rate by year of origination (public PMMS averages).
YEARLY_MORTGAGE_RATE = {
    1971: "0.0754", 1972: "0.0738", 1973: "0.0796", 1974: "0.0919", 1975: "0.0905", 1976: "0.0887",
    1977: "0.0885", 1978: "0.0964", 1979: "0.1120", 1980: "0.1374", 1981: "0.1664", 1982: "0.1604",
    1983: "0.1324", 1984: "0.1388", 1985: "0.1243", 1986: "0.1019", 1987: "0.1021", 1988: "0.1034",
    1989: "0.1032", 1990: "0.1013", 1991: "0.0925", 1992: "0.0839", 1993: "0.0731", 1994: "0.0838",
    1995: "0.0793", 1996: "0.0781", 1997: "0.0760", 1998: "0.0694", 1999: "0.0744", 2000: "0.0805",
    2001: "0.0697", 2002: "0.0654", 2003: "0.0583", 2004: "0.0584", 2005: "0.0587", 2006: "0.0641",
    2007: "0.0634", 2008: "0.0603", 2009: "0.0504", 2010: "0.0469", 2011: "0.0445", 2012: "0.0366",
    2013: "0.0398", 2014: "0.0417", 2015: "0.0385", 2016: "0.0365", 2017: "0.0399", 2018: "0.0454",
    2019: "0.0394", 2020: "0.0311", 2021: "0.0296", 2022: "0.0534", 2023: "0.0681", 2024: "0.0672",
    2025: "0.0670",
}
FIRST_RATE_YEAR = min(YEARLY_MORTGAGE_RATE)
LAST_RATE_YEAR = max(YEARLY_MORTGAGE_RATE)

# Spread over the conventional rate by loan type.
LOAN_TYPE_SPREAD = {
    "conventional": "0", "fha": "-0.0020", "va": "-0.0025", "second": "0.0150", "heloc": "0.0200",
    "hard_money": "0.0400",
}

# Transfer tax as a share of the price, by state.
TRANSFER_TAX_RATE = {"CA": "0.0011", "FL": "0.0070", "NY": "0.0040", "TX": "0", "WA": "0.0128"}

# Base weight of a valuation by type when the assumption set has none.
VALUATION_TYPE_WEIGHT = {
    "avm": "0.30", "comp": "0.35", "comp_listing": "0.15", "list_price": "0.10", "assessed": "0.10",
}

# Weight hint of a resolved valuation by type.
VALUATION_WEIGHT_HINT = {
    "avm": "0.30", "comp": "0.35", "comps": "0.35", "listing": "0.15", "list_price": "0.10", "assessed": "0.10",
}

# Rank of a source kind.
SOURCE_KIND_RANK = {"human": "1.0", "api": "0.9", "report": "0.7", "derived": "0.5", "pasted": "0.45"}

# Lender names written in several ways.
LENDER_ALIASES = {
    "WELLS FARGO BANK NA": "WELLS FARGO",
    "WELLS FARGO HOME MTG": "WELLS FARGO",
    "WELLS FARGO BANK N A": "WELLS FARGO",
    "BANK OF AMERICA NA": "BANK OF AMERICA",
    "BANK OF AMERICA N A": "BANK OF AMERICA",
    "JPMORGAN CHASE BANK NA": "JPMORGAN CHASE",
    "CHASE HOME FINANCE": "JPMORGAN CHASE",
    "NATIONSTAR MTG": "NATIONSTAR",
    "NATIONSTAR MORTGAGE": "NATIONSTAR",
}

# Postal abbreviations of directions, street suffixes and unit designators (USPS Publication 28).
DIRECTIONALS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW",
    "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
STREET_SUFFIXES = {
    "ALLEY": "ALY", "AVENUE": "AVE", "BEND": "BND", "BOULEVARD": "BLVD", "BRANCH": "BR", "BRIDGE": "BR",
    "CANYON": "CYN", "CAUSEWAY": "CSWY", "CENTER": "CTR", "CIRCLE": "CIR", "CLIFF": "CLF", "COURT": "CT",
    "COVE": "CV", "CREEK": "CRK", "CROSSING": "XING", "DRIVE": "DR", "EXPRESSWAY": "EXPY", "EXTENSION": "EXT",
    "FREEWAY": "FWY", "GLEN": "GLN", "GREEN": "GRN", "GROVE": "GRV", "HEIGHTS": "HTS", "HIGHWAY": "HWY",
    "HILL": "HL", "HOLLOW": "HOLW", "JUNCTION": "JCT", "LAKE": "LK", "LANE": "LN", "LOOP": "LOOP",
    "MANOR": "MNR", "MEADOW": "MDW", "MOUNT": "MT", "PARK": "PARK", "PARKWAY": "PKWY", "PASS": "PASS",
    "PATH": "PATH", "PIKE": "PIKE", "PLACE": "PL", "PLAZA": "PLZ", "POINT": "PT", "RIDGE": "RDG",
    "ROAD": "RD", "ROW": "ROW", "RUN": "RUN", "SHORE": "SHR", "SPRING": "SPG", "SQUARE": "SQ",
    "STREET": "ST", "TERRACE": "TER", "TRACE": "TRCE", "TRAIL": "TRL", "TUNNEL": "TUNL", "TURNPIKE": "TPKE",
    "VALLEY": "VLY", "VIEW": "VW", "VILLAGE": "VLG", "WALK": "WALK", "WAY": "WAY",
}
UNIT_DESIGNATORS = {
    "APARTMENT": "APT", "APT": "APT", "SUITE": "STE", "STE": "STE", "UNIT": "UNIT", "BUILDING": "BLDG",
    "BLDG": "BLDG", "FLOOR": "FL", "FL": "FL", "ROOM": "RM", "RM": "RM", "DEPARTMENT": "DEPT", "DEPT": "DEPT",
    "LOT": "LOT", "SPACE": "SPC", "SPC": "SPC", "TRAILER": "TRLR", "TRLR": "TRLR",
}

# Words for a lien position.
POSITION_WORDS = {
    "first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3",
}

# Other names of a field, per entity type. The last entries of property, mortgage, lien and
# valuation let the names used by the extraction schemas reach the record as well.
FIELD_ALIASES = {
    "property": {
        "address": "line1", "street": "line1", "zip": "zip5", "zipcode": "zip5", "zip_code": "zip5",
        "type": "property_type", "owner": "owner_name", "owners": "owner_name",
        "owner_occupied": "is_owner_occupied", "absentee": "is_absentee",
        "purchase_date": "ownership_start_date", "last_sale_date": "ownership_start_date",
        "last_sale_price": "purchase_price", "hoa_dues": "monthly_dues", "hoa_monthly_dues": "monthly_dues",
        "hoa_arrears": "arrears", "hoa_lien": "has_lien", "hoa_has_lien": "has_lien",
        "address_line1": "line1",
    },
    "mortgage": {
        "amount": "original_amount", "original": "original_amount", "original_balance": "original_amount",
        "loan_amount": "original_amount", "current_balance": "balance", "estimated_balance": "balance",
        "interest_rate": "rate", "term": "term_months", "loan_term_months": "term_months",
        "date": "origination_date", "loan_date": "origination_date", "doc": "recording_doc_number",
        "doc_number": "recording_doc_number", "document_number": "recording_doc_number",
        "lender_name": "lender", "open": "is_open", "lender_raw": "lender",
    },
    "lien": {
        "type": "lien_type", "creditor_name": "creditor", "doc_number": "recording_doc_number",
        "document_number": "recording_doc_number", "date": "recording_date", "basis": "attachment_basis",
        "priority_position": "priority", "creditor_raw": "creditor",
    },
    "valuation": {
        "type": "valuation_type", "amount": "value", "estimate": "value", "low": "value_low",
        "high": "value_high", "confidence": "reported_confidence", "date": "as_of", "weight": "weight_hint",
        "as_of_date": "as_of",
    },
    "foreclosure": {
        "sale_date": "current_sale_date", "bid": "published_bid", "trustee_name": "trustee",
        "date": "event_date", "type": "event_type", "active": "is_active",
    },
    "bankruptcy": {"date": "filing_date", "filing_sequence": "sequence"},
    "tax": {
        "taxes": "annual_taxes", "annual_tax": "annual_taxes", "assessed": "assessed_value",
        "delinquent": "delinquent_amount",
    },
    "rental": {"rent": "rent_estimate", "monthly_rent": "rent_estimate"},
    "listing": {"date": "list_date", "list_price": "price", "days_on_market": "dom"},
    "comp": {"sale_price": "price", "distance_miles": "distance", "similarity_score": "similarity"},
    "condition": {"ladder": "condition", "level": "condition"},
}

# Fields that decay as money, and the side a tie is broken to.
MONEY_FIELDS = (
    "amount", "original_amount", "balance", "value", "value_low", "value_high", "price", "purchase_price",
    "rent_estimate", "annual_taxes", "assessed_value", "delinquent_amount", "arrears", "monthly_dues",
    "published_bid", "default_amount",
)
LIABILITY_FIELDS = (
    "amount", "original_amount", "balance", "delinquent_amount", "arrears", "monthly_dues", "published_bid",
    "default_amount",
)
ASSET_FIELDS = ("value", "price", "rent_estimate", "purchase_price")

# The fields whose presence makes up critical coverage.
CRITICAL_FIELDS = (
    "apn", "address", "sqft", "beds", "baths", "year_built", "owner", "occupancy", "last_sale_date",
    "last_sale_price", "avm", "comp_estimate", "assessed_value", "annual_taxes", "mortgage_1_original",
    "mortgage_1_date", "mortgage_1_rate", "mortgage_1_balance", "foreclosure_status", "lien_count",
    "lien_total", "rent",
)
