"""Codes and digests: Crockford base 32 with a check digit, the order-sensitive fingerprint."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Fixed value: digits of Crockford's base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def normal(code: str) -> str:
    """Upper case, without blanks and dashes, letters that look like digits as digits."""
    return code.upper().translate(str.maketrans({" ": None, "-": None, "I": "1", "L": "1", "O": "0", "U": "V"}))


def check_digit(code: str) -> str:
    total = 0
    for c in code:
        total = (33 * total + ALPHABET.index(c) + 1) % 32
    return ALPHABET[total]


def encoded(data: bytes) -> str:
    """Five bits a digit, the last padded with zeros, then the check digit."""
    bits = "".join(f"{b:08b}" for b in data)
    bits += "0" * (-len(bits) % 5)
    code = "".join(ALPHABET[int(bits[k : k + 5], 2)] for k in range(0, len(bits), 5))
    return code + check_digit(code)


def decoded(code: str) -> bytes:
    """The bytes of a code; ValueError if a digit or the check digit is wrong."""
    body, check = normal(code)[:-1], normal(code)[-1:]
    if any(c not in ALPHABET for c in body + check) or not body or check_digit(body) != check:
        raise ValueError("wrong code")
    bits = "".join(f"{ALPHABET.index(c):05b}" for c in body)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits) - 7, 8))


def fingerprint(ids: list[str]) -> str:
    """Number of ids and the 32-bit polynomial (31) over their characters, in order."""
    h = 0
    for c in "".join(ids):
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return f"{len(ids)}:{h:x}"


@F.pandas_udf(StringType())
def code(data: pd.Series) -> pd.Series:
    """The code of binary values; null for null."""
    return data.map(lambda b: None if b is None else encoded(bytes(b)))


@F.pandas_udf(BinaryType())
def bytes_of(text: pd.Series) -> pd.Series:
    """The bytes of codes as people type them; null for what is no code."""

    def one(t: str | None) -> bytes | None:
        try:
            return decoded(t or "")
        except ValueError:
            return None

    return text.map(one)


MODULUS = 1 << 32


def _times(a: Column, b: Column) -> Column:
    return F.pmod(a.cast("decimal(38,0)") * b, F.lit(MODULUS)).cast("long")


def ordered_fingerprints(df: DataFrame, keys: list[str], order: list[str], bucket: Column, id_: str = "id") -> DataFrame:
    """Per key the fingerprint of its ids in order, as ``fingerprint`` gives it.

    The polynomial of joined texts follows from their own and the power for their length, so ids meet by
    stretches of the order (``bucket`` rises with it) and a key's stretches, a row each, are put together.
    """

    def fold(text: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"))
        return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), start, lambda s, c: F.struct(((31 * s["h"] + F.ascii(c)) % MODULUS).alias("h"), ((31 * s["p"]) % MODULUS).alias("p")))

    rows = df.select(*keys, bucket.alias("__b"), F.struct(*order, F.col(id_).alias("__id")).alias("x"))
    parts = rows.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("*").alias("n"))
    parts = parts.select(*keys, "__b", "n", fold(F.array_join("x.__id", "")).alias("f"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__b", "f"))).alias("fs"), F.sum("n").alias("n"))
    value = F.aggregate("fs", F.lit(0).cast("long"), lambda h, x: ((_times(h, x["f"]["p"]) + x["f"]["h"]) % MODULUS).cast("long"))
    return whole.select(*keys, F.concat(F.col("n").cast("string"), F.lit(":"), F.lower(F.hex(value))).alias("fingerprint"))
