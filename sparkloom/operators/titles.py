"""Titles that are nearly the same, as a join: all pairs whose ratio of matching blocks reaches a bound.

The ratio of two texts is 2 M / s, with s characters in both and M in their matching blocks.  Texts that are equal once
folded are one class, so copies never meet each other.  Between classes:

* A ratio of p per cent needs M >= p s / 200; as M is at most the shorter length, lengths can't be far apart.
* The blocks stand in the same order in both, so s - 2 M characters taken out and put in make one text of the other.
  Each changes the counts of letters by one, and those of q-grams by 2 q - 1 at most, whatever is counted together.

So texts become counts of letters and of grams (``PROFILE`` small numbers), and these are compared: all pairs of near
lengths, in numpy.  Lengths are dealt out in ranges, so that similar ones lie in one or in two neighbouring ones, and ranges
in blocks of about ``BLOCK`` texts.  Two blocks meet in one place, and so do two texts: no pair comes twice, none is
stored for a gram, and a task holds two blocks.  Of the pairs that are left, those go of whose pieces too few stand in the
other text, and the others' ratio is computed, so the result is exact.  The comparisons grow with the square of the texts; of
its counts a text has a copy for each ``BLOCK`` texts of its own range and the two beside it.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from sparkloom.functions import text

BLOCK = 8192
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_PLACE = np.full(128, len(_LETTERS), np.int64)
_PLACE[[ord(c) for c in _LETTERS]] = range(len(_LETTERS))
LETTERS, GRAMS = len(_LETTERS) + 1, 128  # the last letter stands for all others; grams are counted together by hash
PROFILE = LETTERS + GRAMS


def plain(title: Column) -> Column:
    """The words of a title, folded, with single blanks between them; null: empty."""
    return F.array_join(F.filter(F.split(text.folded(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != ""), " ")


def classes(items: DataFrame) -> DataFrame:
    """(class_id, plain, copies) of items (id, title): the smallest id of each plain title.  Items without an id are passed
    over, and so are titles without a word, which are like nothing."""
    rows = items.where(F.col("id").isNotNull()).select("id", plain(F.col("title")).alias("plain")).where("plain <> ''")
    return rows.groupBy("plain").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))


def gram_length(percent: int) -> int:
    """The grams that are counted: of two characters, or of one where texts that have none in common may be similar."""
    return 2 if 3 * (100 - percent) < 100 else 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _profile(x: str, q: int) -> np.ndarray:
    """How often each letter and each bucket of q-grams stands in a text; counts stop at 65,535, which brings none apart."""
    points = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    letters = np.bincount(_PLACE[np.minimum(points, 127)], minlength=LETTERS)
    size = max(len(points) - q + 1, 0)
    h = np.zeros(size, np.uint64)
    for k in range(q):
        h = _mixed(h + points[k : k + size].astype(np.uint64) + np.uint64(1))
    grams = np.bincount((h % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS)
    return np.minimum(np.concatenate([letters, grams]), 65535).astype(np.uint16)


def _placed(texts: DataFrame, percent: int, q: int, most: int) -> DataFrame:
    """(range, one, upper, other, second, class_id, n, profile): a row of a text for each pair of blocks that has its block.
    The pair is of blocks ``one`` and ``other`` of a range, or with ``upper`` 1 of a range and the next; ``second``: of ``other``."""

    @F.pandas_udf(BinaryType())
    def profile_of(xs: pd.Series) -> pd.Series:
        return pd.Series([_profile(x, q).tobytes() for x in xs])

    width = math.log((200 - percent) / percent) * 1.0001  # similar lengths lie in one range or in two neighbouring ones
    rows = texts.withColumn("range", F.floor(F.log("n") / width).cast("int"))
    sizes = rows.groupBy("range").count().collect()  # lengths are below 2^31, so there are few ranges
    known = F.create_map(*(F.lit(x) for r in sizes for x in (r["range"], -(-r["count"] // most)))) if sizes else F.create_map().cast("map<int,int>")
    rows = rows.withColumn("known", F.coalesce(F.try_element_at(known, F.col("range")), F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("known")).cast("int"))

    def blocks(of: Column) -> Column:
        n = F.coalesce(F.try_element_at(known, of), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def pair(of: Column, one: Column, upper: int, other: Column, second: Column) -> Column:
        return F.struct(of.alias("range"), one.alias("one"), F.lit(upper).alias("upper"), other.alias("other"), second.alias("second"))

    own, block = F.col("range"), F.col("block")
    within = F.transform(blocks(own), lambda j: pair(own, F.least(block, j), 0, F.greatest(block, j), block > j))
    above = F.transform(blocks(own + 1), lambda j: pair(own, block, 1, j, F.lit(False)))
    below = F.transform(blocks(own - 1), lambda j: pair(own - 1, j, 1, block, F.lit(True)))
    return rows.select(F.explode(F.concat(within, above, below)).alias("p"), "class_id", "n", profile_of("plain").alias("profile")).select("p.*", "class_id", "n", "profile")


def _compared(percent: int, q: int):
    """Of the texts of a pair of blocks, the pairs (a, b) whose counts are near enough, a the shorter."""

    def half(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, ids = rows.column("n").to_numpy(), rows.column("class_id").to_numpy()
        order = np.argsort(n, kind="stable")
        counts = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint16).reshape(-1, PROFILE)[order]
        return n[order], ids[order], np.ascontiguousarray(counts.T, np.int32)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        of, one, upper, other = (k.as_py() for k in key)
        n, ids, counts = half(rows.filter(pc.invert(rows.column("second"))))
        alone = upper == 0 and one == other
        to_n, to_ids, to = (n, ids, counts) if alone else half(rows.filter(rows.column("second")))
        lo = np.arange(1, len(n) + 1) if alone else np.searchsorted(to_n, -(-n * percent // (200 - percent)))
        hi = np.searchsorted(to_n, n * (200 - percent) // percent, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(lo < hi).tolist():
            a, b = lo[i], hi[i]
            s = n[i] + to_n[a:b]
            out_in = s - 2 * -(-s * percent // 200)
            near = np.flatnonzero(np.abs(to[:LETTERS, a:b] - counts[:LETTERS, i : i + 1]).sum(0, np.int32) <= out_in)
            if len(near):
                near = near[np.abs(to[LETTERS:, a + near] - counts[LETTERS:, i : i + 1]).sum(0) <= (2 * q - 1) * out_in[near]]
                found.append((np.full(len(near), i), a + near))
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        shorter = (n[x] < to_n[y]) | ((n[x] == to_n[y]) & (ids[x] < to_ids[y]))
        return pa.table({"a": np.where(shorter, ids[x], to_ids[y]), "b": np.where(shorter, to_ids[y], ids[x])})

    return compare


def _candidates(texts: DataFrame, percent: int, q: int, most: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of texts (class_id, plain, n), a the shorter, whose counts allow the ratio; each pair once."""
    where = ["range", "one", "upper", "other"]
    width, kind = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.schema["class_id"].dataType.simpleString()
    return _placed(texts, percent, q, most).repartition(width, *where).groupBy(*where).applyInArrow(_compared(percent, q), f"a {kind}, b {kind}")


def _apart(x: str, y: str, out_in: int, size: int) -> bool:
    """Whether more pieces of x are missing in y than so many characters, taken out and put in, can spoil or move away."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    missing = 0
    for k in range(0, len(x) - size + 1, size):
        if y.find(x[k : k + size], max(k - out_in, 0), k + size + out_in) < 0:
            missing += 1
            if missing > out_in:
                return True
    return False


def _ratio_from(percent: int):
    size = 40 // (100 - percent)  # so long that a fifth of the pieces has to be there

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, last = difflib.SequenceMatcher(), None

        def one(x: str, y: str) -> float | None:
            nonlocal last
            s = len(x) + len(y)
            if size > 2 and _apart(x, y, s - 2 * -(-s * percent // 200), size):
                return None
            if y != last:  # what is known of the second text serves for the next pair
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            return matcher.ratio()

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def similar(classes: DataFrame, percent: int = 95) -> DataFrame:
    """(first, second, ratio) of all pairs of classes whose ratio reaches that percentage, first < second.

    The ratio depends on which text comes first; here that is the class of the smaller id."""
    if not 0 < percent < 100:
        raise ValueError("a percentage between 0 and 100")
    texts = classes.select("class_id", "plain", F.length("plain").cast("long").alias("n"))
    pairs = _candidates(texts, percent, gram_length(percent)).select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"))
    named = lambda c: texts.select(F.col("class_id").alias(c), F.col("plain").alias(f"{c}_plain"))
    both = pairs.join(named("first"), "first").join(named("second"), "second")
    return both.select("first", "second", _ratio_from(percent)("first_plain", "second_plain").alias("ratio")).where(F.col("ratio") >= percent / 100)
