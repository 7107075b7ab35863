"""The country of a free-text location, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.binding import bound
from gleaner.functions.fixed import (
    CANADIAN_PROVINCES,
    COUNTRY_OF,
    LOCATION_COUNT,
    LOCATION_QUALIFIER,
    LOCATION_SEPARATOR,
    PARENTHETICAL,
    PLACEHOLDERS,
    US_STATE_NAMES,
    US_STATES,
)

#: What stands after a city and what it means.
_REGIONS = dict.fromkeys(CANADIAN_PROVINCES, "Canada") | dict.fromkeys(US_STATES, "United States")
_REGION_NAMES = dict.fromkeys(US_STATE_NAMES, "United States")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Null for what isn't in the table, which one hashed test tells; else one branch a value."""
    out = F.lit(None).cast("string")
    for value in dict.fromkeys(table.values()):
        out = F.when(key.isin([k for k, v in table.items() if v == value]), value).otherwise(out)
    return F.when(key.isin(list(table)), out)


def split_locations(location: Column) -> Column:
    """Parts of a location that names several; the word "or" parts them too, in any case."""
    parts = F.transform(F.split(F.coalesce(location, F.lit("")), LOCATION_SEPARATOR), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _of_segment(segment: Column, several: Column) -> Column:
    return bound(F.trim(F.regexp_replace(segment, r"[.\s]+", " ")), lambda flat: _of_flat(flat, segment, several))


def _of_flat(flat: Column, segment: Column, several: Column) -> Column:
    zip_state = F.regexp_extract(flat, r"^([a-z]{2})\s+\d{5}(?:-\d{4})?$", 1)
    code = F.replace(flat, F.lit(" "), F.lit(""))
    region = F.coalesce(F.when(code.isin(US_STATES), "United States"), F.when(code.isin(CANADIAN_PROVINCES), "Canada"), _lookup(_REGION_NAMES, flat))
    return F.coalesce(_lookup(COUNTRY_OF, flat), _lookup(COUNTRY_OF, segment), F.when(several, region), F.when(zip_state.isin(US_STATES), "United States"))


def country_of_one(location: Column) -> Column:
    """Country of a single location, from its right-most telling segment; empty if none tells."""
    text = F.trim(F.regexp_replace(F.regexp_replace(location, LOCATION_QUALIFIER, ""), PARENTHETICAL, ""))
    text = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return bound(text, lambda t: F.when((t == "") | t.isin(PLACEHOLDERS) | t.rlike(LOCATION_COUNT), "").otherwise(
        F.coalesce(_lookup(COUNTRY_OF, t), bound(F.split(t, ","), _rightmost), F.lit(""))))


def _rightmost(segments: Column) -> Column:
    """The country of the last segment that tells one."""
    bare = F.filter(F.transform(segments, lambda x: F.trim(x)), lambda x: x != "")
    told = lambda found: F.transform(F.reverse(found), lambda s: _of_segment(s, F.size(found) > 1))
    return bound(bare, lambda found: F.try_element_at(F.filter(told(found), lambda x: x.isNotNull()), F.lit(1)))


def derive_country(location: Column) -> Column:
    """The one country that a location's parts name; empty for none, for several, and for null."""
    named = F.array_distinct(F.filter(F.transform(split_locations(location), country_of_one), lambda x: x != ""))
    return bound(named, lambda x: F.when(F.size(x) == 1, F.try_element_at(x, F.lit(1))).otherwise(""))
