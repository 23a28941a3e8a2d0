"""Quality rules as a bitmask ledger.

``ledger`` reads each text once and gives, per row, the measurements and one failure bit for
each rule; ``stored`` writes that as a table, which all that follows reads.  A *policy* is a named, versioned mask over those bits: a row is kept if none of the
mask's bits are set, so a new policy needs no second look at the texts.  ``apply_policies`` adds
one column per policy, and ``ablations`` counts, by aggregation of the bits alone, what each
rule rejects, what it alone rejects, and what a policy would keep without it.

A null or empty text has no words: all counts are 0 and it fails few_words.  Repeated rows get
equal rows; an empty table gives an empty ledger; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkloom.llm.common import documents, id_and_text, per_slice, text_bytes, written

#: Rule by bit.  Each is a test on the measurements of one text.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_trigrams": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length": lambda m: not 2 * m["n_words"] <= m["word_chars"] <= 15 * m["n_words"],
    "capitals": lambda m: 10 * m["n_capital_words"] > 3 * m["n_words"],
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_trigrams"]
#: Policies by version: the mask of the rules that count.
POLICIES = {"v1": BASE, "v2": BASE | BITS["symbols"] | BITS["repeated_lines"], "v3": sum(BITS.values())}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed_bits long"
_SYMBOLS = b"#*$%&|<>"
_NOT_START = bytes(range(0x80, 0xC0))  # UTF-8 bytes that continue a code point
_WHITE = b" \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, total, upto = Counter(windows), 0, 0
    for k, window in enumerate(windows):
        if found[window] > 1:
            total += k + 3 - max(k, upto)
            upto = k + 3
    return total


def measure(text: bytes) -> dict[str, int]:
    """All measurements of one UTF-8 text."""
    words = text.split()  # bytes split at 0x20 and 0x09 to 0x0D alone
    lines = [line for line in text.split(b"\n") if line.strip(_WHITE)]
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, _NOT_START + _WHITE)),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_capital_words": sum(map(_shouted, words)) if any(map(bytes.isupper, words)) else 0,
    }


def _shouted(word: bytes) -> bool:
    return word.isupper() and len(word) > 1


def failed_bits(measured: dict[str, int]) -> int:
    return sum(bit for name, bit in BITS.items() if RULES[name](measured))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in text_bytes(batch.column(1))]
        cols = [pa.array([m[k] for m in found], pa.int64()) for k in MEASURES]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(map(failed_bits, found), pa.int64())], names=["doc_id", *MEASURES, "failed_bits"])

    return id_and_text(docs).mapInArrow(per_slice(work), SCHEMA)


@F.arrow_udf(LongType())
def rule_bits(text: pa.Array) -> pa.Array:
    """The ledger's failed_bits of a text column, for frames that keep their other columns."""
    return pa.array([failed_bits(measure(t or b"")) for t in text_bytes(text)], pa.int64())


def kept_by(policy: str) -> F.Column:
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policies(book: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """The ledger with keep_<version> for each policy."""
    return book.withColumns({f"keep_{v}": F.col("failed_bits").bitwiseAND(F.lit(mask)) == 0 for v, mask in policies.items()})


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail it alone, rows kept without it.

    The ledger shrinks to one row per distinct bit pattern first (at most 2 ** rules).
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BITS.items() if b & mask))).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations never see the texts again."""
    return written(ledger(docs), "ledger")


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0
    book = apply_policies(stored(documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept_by(CURRENT).alias("kept"), "failed_bits", *(f"keep_{v}" for v in POLICIES))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone rejects, and what would be kept without it."""
    return ablations(stored(documents(spark, sf_dir)))


#: Words are those of [^\x20\x09-\x0D]+; whatever else a rule needs is counted as in ``measure``.
OP9_SQL = (
    r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT k, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT k, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM p WINDOW v AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS c FROM q WHERE c IS NOT NULL),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_capital_words
      FROM w LEFT JOIN r ON w.k = r.k),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (NOT word_chars BETWEEN 2 * n_words AND 15 * n_words)::BIGINT
             + 32 * (10 * n_capital_words > 3 * n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits, """
    + ", ".join(f"failed_bits & {mask} = 0 AS keep_{v}" for v, mask in POLICIES.items())
    + " FROM f"
)
ABLATIONS_SQL = f"""
WITH l AS ({OP9_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BITS.items())})
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS failed, count(*) FILTER (WHERE failed_bits = bit) AS failed_alone,
       count(*) FILTER (WHERE failed_bits IN (0, bit)) AS kept_without FROM l CROSS JOIN r GROUP BY rule
"""
