"""Places in text: states, countries, postal codes, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# States and provinces by code.
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico",
}
CA_PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories",
    "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
# Other spellings of states, and countries by name.
STATE_SPELLINGS = {"washington dc": "DC", "d.c.": "DC", "québec": "QC", "pei": "PE"}
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US", "canada": "CA", "united kingdom": "GB", "uk": "GB", "england": "GB",
    "scotland": "GB", "wales": "GB", "ireland": "IE", "france": "FR", "belgium": "BE", "netherlands": "NL", "the netherlands": "NL", "germany": "DE", "austria": "AT",
    "switzerland": "CH", "denmark": "DK", "sweden": "SE", "norway": "NO", "finland": "FI", "italy": "IT", "spain": "ES", "portugal": "PT", "australia": "AU", "new zealand": "NZ",
    "japan": "JP", "south korea": "KR", "korea": "KR", "hong kong": "HK", "taiwan": "TW", "singapore": "SG",
}
CA_POSTAL = r"(?i)^[ABCEGHJ-NPRSTVXY]\d[A-Z][ -]?\d[A-Z]\d$"
_BY_NAME = {name.lower(): code for code, name in (US_STATES | CA_PROVINCES).items()} | STATE_SPELLINGS
_CODES = "|".join(sorted(US_STATES | CA_PROVINCES))
# A North American address, and words that end its street.
ADDRESS = rf"(?<street>\d{{1,6}}\s[\w .'#-]{{3,60}}?,\s*)?(?<city>[A-Z][A-Za-z.' -]{{1,30}}?),?\s+(?<state>{_CODES})\.?,?\s+(?<postal>\d{{5}}(?:-\d{{4}})?|[A-Z]\d[A-Z]\s?\d[A-Z]\d)\b"
STREET_END = r"(?i)^.*\b(st|street|rd|road|ave|avenue|blvd|boulevard|dr|drive|ln|lane|pkwy|parkway|way|hwy|highway|cir|circle|ct|court|pl|place|sq|square|suite|ste|unit|n|s|e|w)\.?\s+"


def _text(s: Column) -> Column:
    return F.trim(F.coalesce(s, F.lit("")))


def state_code(s: Column) -> Column:
    """The code of a state or province by name or code; empty for anything else."""
    t = F.trim(F.regexp_replace(_text(s), r"\.+$", ""))
    return F.when(F.upper(t).isin(*US_STATES, *CA_PROVINCES), F.upper(t)).otherwise(F.coalesce(lookup(_BY_NAME, F.lower(t)), F.lit("")))


def country_of_state(s: Column) -> Column:
    code = state_code(s)
    return F.when(code.isin(*CA_PROVINCES), "CA").when(code.isin(*US_STATES), "US").otherwise("")


def infer_country(country: Column, state: Column, postal: Column) -> Column:
    """From what is known: the country's name, else a Canadian postal code, else the state; empty if nothing tells."""
    c = _text(country)
    named = F.coalesce(lookup(COUNTRIES, F.lower(c)), F.left(F.upper(c), F.lit(2)))
    return F.when(c != "", named).when(_text(postal).rlike(CA_POSTAL), "CA").otherwise(country_of_state(state))


def region_of(location: Column, default: Column) -> Column:
    """The country of a place such as ``Boulder, CO``, by what follows its last comma."""
    last = F.trim(F.substring_index(location, ",", -1))
    return F.coalesce(lookup(COUNTRIES, F.lower(last)), F.nullif(country_of_state(last), F.lit("")), default)


def normalize_postal(s: Column) -> Column:
    """A Canadian code as ``A1A 1A1``, other codes in upper case."""
    t = F.upper(_text(s))
    return F.when(t.rlike(CA_POSTAL), F.regexp_replace(F.regexp_replace(t, "[ -]", ""), "^(.{3})(.{3})$", "$1 $2")).otherwise(t)


def addresses(text: Column) -> Column:
    """All addresses of a text, in order: street, city, state and postal code. A street's end is no part of the city."""
    parts = [F.regexp_extract_all(text, F.lit(ADDRESS), i) for i in (1, 2, 3, 4)]

    def one(street: Column, i: Column) -> Column:
        city, state, postal = (F.get(p, i) for p in parts[1:])
        return F.struct(F.regexp_replace(street, r"^[ ,]+|[ ,]+$", "").alias("street"), F.trim(F.regexp_replace(F.trim(city), STREET_END, "")).alias("city"), state.alias("state"), F.upper(postal).alias("postal"))

    return F.transform(parts[0], one)
