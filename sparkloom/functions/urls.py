"""Hosts and sites of URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac")


def host(url: Column) -> Column:
    """Host in lower case, without www; null where there is none."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), "^www\\.", "")


def site(url: Column) -> Column:
    """The registrable name: two labels, three under a country's second-level name."""
    labels = F.split(host(url), "\\.")
    three = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    n = F.least(F.size(labels), F.when(three, 3).otherwise(2))
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def same_site(a: Column, b: Column) -> Column:
    return site(a) == site(b)
