"""Text functions: keys, excerpts, whole words, similarity."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from sparkloom.functions.batches import per_value


def _bare_letters() -> dict[str, str]:
    """Lower-case letters of Latin, Greek and Cyrillic with marks -> without them, by canonical decomposition."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if bare != c and len(bare) == 1 and c == c.lower():
            out[c] = bare
    return out


_BARE = _bare_letters()
_MARKS = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))


def folded(text: Column) -> Column:
    """Lower case without combining marks, whether letters are composed or not; stays in generated code."""
    return F.translate(F.lower(text), "".join(_BARE) + _MARKS, "".join(_BARE.values()))


def _normal(t: str | None) -> str:
    """Any script: accents stripped, lower case, runs of blanks as one."""
    bare = "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", bare).strip().lower()


normalised = per_value(StringType())(_normal)


def title_key(title: Column) -> Column:
    """Lower case letters and digits, everything else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def item_key(doi: Column, title: Column) -> Column:
    """The DOI if there is one, else the title's key up to 120 characters."""
    return F.coalesce(F.nullif(F.lower(F.trim(doi)), F.lit("")), F.substring(title_key(title), 1, 120))


def words(text: Column) -> Column:
    """The distinct words of a text, folded."""
    return F.array_distinct(F.filter(F.split(folded(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def has_word(text: Column, term: str) -> Column:
    """Whether the term stands in the text as a whole word, in any script."""
    return text.rlike(rf"(?U)(?<!\w){re.escape(term)}(?!\w)")


def excerpt(text: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last blank if that is past the middle, with an ellipsis."""
    head = F.substring(text, 1, most)
    blank = F.lit(most) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (blank >= most / 2), F.rtrim(F.substr(head, F.lit(1), blank - 1))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two short texts (not an edit distance)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


#: Names of the archives.
ARCHIVES = {
    "arxiv": "arXiv", "openalex": "OpenAlex", "doaj": "DOAJ", "crossref": "Crossref", "zenodo": "Zenodo",
    "europepmc": "Europe PMC", "doab": "DOAB", "gutenberg": "Project Gutenberg", "standard_ebooks": "Standard Ebooks",
}


def source_name(source: Column) -> Column:
    """A source as readers know it: a feed's own name out of rss[...], else the first of joined sources without
    its bracket, by the archive's name; empty for none.  A feed's name may hold brackets and plus signs."""
    feed = F.regexp_extract(F.trim(source), r"^rss\[(.*?)\](?:\+|$)", 1)
    first = F.regexp_replace(F.trim(F.substring_index(source, "+", 1)), r"\[.*\]$", "")
    names = F.create_map(*(F.lit(x) for pair in ARCHIVES.items() for x in pair))
    return F.coalesce(F.when(F.trim(source).rlike(r"^rss\[.*?\](\+|$)"), F.trim(feed)), F.try_element_at(names, first), first, F.lit(""))


def scrubbed(text: Column) -> Column:
    """Without NUL characters, which text columns of other stores refuse."""
    return F.regexp_replace(text, "\\x00", "")


def hashed_id(key: Column, prefix: str = "RAS-", length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key.cast("binary")), 1, length))


def grade(relevance: Column) -> Column:
    """0 to 100, rising ever more slowly: 100 r / (r + 5), rounded half to even; 0 for r <= 0."""
    return F.when(relevance > 0, F.bround(F.lit(100.0) * relevance / (relevance + 5), 0).cast("int")).otherwise(0)
