"""Judging a query by its result, not by its text.

Cells are compared by a typed key: null apart from every value, whole numbers as such, other
numbers to six decimals, text as text - so 10, 10.0 and '10' are alike and null is never ''.
Rows are counted as a multiset with one shuffle; positions are looked at only if order matters.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Verdict(str, Enum):
    SAME = "identico"
    SAME_BUT_ORDER = "identico_a_meno_dell_ordine"
    ORDER = "ordine_diverso"
    COLUMNS = "colonne_diverse"
    ROWS = "righe_diverse"
    VALUES = "valori_diversi"
    ERROR = "errore_sql"
    PREPARATION = "errore_preparazione"
    REFERENCE = "errore_riferimento"


def cell(value: Column, kind: T.DataType) -> Column:
    """The comparable text of a cell; null for null."""
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = (F.abs(value) < 1e15) & (value == F.floor(value))
        return F.when(value.isNull(), None).when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.6f", value.cast("double")))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def keyed(df: DataFrame) -> DataFrame:
    """One column, key: the row's cells as an array (names and duplicate names do not matter)."""
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return named.select(F.array(*(cell(F.col(f.name), f.dataType) for f in named.schema.fields)).alias("key"))


def multiset_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Keys whose counts differ: key, n_expected, n_got."""
    both = keyed(expected).select("key", F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(keyed(got).select("key", F.lit(0).alias("e"), F.lit(1).alias("g")))
    return both.groupBy("key").agg(F.sum("e").alias("n_expected"), F.sum("g").alias("n_got")).where("n_expected <> n_got")


def same_order(expected: DataFrame, got: DataFrame) -> bool:
    """Whether rows agree position by position; the frames must be ordered results."""

    def numbered(df: DataFrame) -> DataFrame:
        # An ordered result's partitions are in order: a row's position is its partition's start and its place in it.
        placed = keyed(df).withColumns({"p": F.spark_partition_id(), "k": F.monotonically_increasing_id()})
        starts = placed.groupBy("p").agg(F.count("*").alias("n"))
        first = starts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("first"))  # one row per partition
        return placed.join(F.broadcast(first), "p").select((F.col("first") + F.col("k").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "key")

    a, b = numbered(expected).alias("a"), numbered(got).alias("b")
    return a.join(b, F.col("a.at") == F.col("b.at"), "full").where(~F.col("a.key").eqNullSafe(F.col("b.key"))).isEmpty()


def judged(expected: DataFrame, got: DataFrame, ordered: bool = False, strict_names: bool = False) -> Verdict:
    """The verdict, from the cheapest test to the dearest."""
    if len(expected.columns) != len(got.columns) or strict_names and expected.columns != got.columns:
        return Verdict.COLUMNS
    if expected.count() != got.count():
        return Verdict.ROWS
    if not multiset_difference(expected, got).isEmpty():
        return Verdict.VALUES
    if same_order(expected, got):
        return Verdict.SAME
    return Verdict.ORDER if ordered else Verdict.SAME_BUT_ORDER


def judged_sql(spark, reference: str, answer: str, ordered: bool = False, preparation: list[tuple[str, str]] = (), run=None) -> tuple[Verdict, str | None]:
    """Verdict on an answer's text against a reference's, and what the engine said.

    The preparation is (view, SELECT) pairs.  What does not run is an error of the preparation, the
    reference or the answer, in this order, and never an exception.  ``run`` turns a text into a frame.
    """
    run = run or spark.sql
    rung = Verdict.PREPARATION
    try:
        for name, select in preparation:
            run(select).createOrReplaceTempView(name)
        rung = Verdict.REFERENCE
        expected = run(reference)
        expected.count()
        rung = Verdict.ERROR
        return judged(expected, run(answer), ordered), None
    except Exception as problem:  # any engine error belongs to the rung that was reached
        return rung, str(problem).split("\n")[0]


#: How an exercise's text asks for an order.
ORDER_WORDS = r"(?i)ordin|dal più|dalla più|prime? \d|ultim|classific|posizione|decrescent|crescent"


def asks_for_order(prompt: Column, solution: Column) -> Column:
    """Whether the order of rows matters, as far as the words of a task and a LIMIT in its solution tell."""
    return prompt.rlike(ORDER_WORDS) | F.regexp_replace(solution, "'[^']*'", "''").rlike(r"(?i)\blimit\b")


def validated(spark, statements: dict[str, str], run=None) -> DataFrame:
    """(name, problem) of reference statements that do not run, give no rows, or give others the second time."""
    run, rows = run or spark.sql, []
    for name, sql in statements.items():
        try:
            first = run(sql)
            problem = "no rows" if first.isEmpty() else None if judged(first, run(sql)) == Verdict.SAME else "not repeatable"
        except Exception as error:  # any engine error is the statement's own
            problem = f"does not run: {str(error).split(chr(10))[0][:200]}"
        rows.append((name, problem))
    return spark.createDataFrame(rows, "name string, problem string").where("problem IS NOT NULL")
