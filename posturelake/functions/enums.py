"""Enumerations of the data model: parsing with a default, ranks and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "informational": 0}
CONFIDENCE_RANK = {"confirmed": 6, "observed": 5, "probable": 4, "possible": 3, "unknown": 2, "not_observed": 1}
SUPPORT_RANK = {"full": 5, "partial": 4, "limited": 3, "requires_privilege": 2, "unavailable": 1}
SCOPE_WEIGHT = {"loopback": 0, "local": 1, "container": 2, "virtual": 2, "vpn": 3, "lan": 4, "wildcard": 5, "public": 5, "unknown": 2}
PRIVILEGE_WEIGHT = {"none": 0.0, "user": 0.34, "elevated": 0.67, "system": 1.0}
SENSITIVITY_WEIGHT = {"public": 0.0, "internal": 0.4, "sensitive": 0.75, "secret": 1.0}
PLATFORMS = ("linux", "windows", "darwin", "termux")
STATUS_ORDER = {"complete": 1, "partial": 2, "degraded": 3, "requires_privilege": 4, "skipped": 5}

#: What an unknown value of each enumeration parses to.
DEFAULTS = {"severity": (SEVERITY_RANK, "informational"), "confidence": (CONFIDENCE_RANK, "unknown"), "support": (SUPPORT_RANK, "unavailable"), "scope": (SCOPE_WEIGHT, "unknown"), "privilege": (PRIVILEGE_WEIGHT, "none"), "sensitivity": (SENSITIVITY_WEIGHT, "internal")}


def lookup(value: Column, table: dict, default) -> Column:
    """``table[value]``, or ``default`` for what is null or not in it."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(default))


def parse(value: Column, name: str) -> Column:
    """FN-18: the value in lower case and without outer blanks, or the enumeration's default."""
    known, default = DEFAULTS[name]
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*known), clean).otherwise(default)


def severity_rank(value: Column) -> Column:
    return lookup(value, SEVERITY_RANK, 1)
