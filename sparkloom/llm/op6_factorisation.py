"""A factorisation machine for text quality.

A text is a sparse vector: its distinct hashed words (each 1 / sqrt of their number), statistics
of its structure, and how its recorded length (the n_chars column, as metadata) differs from its
real one.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term, by the sum-of-squares identity, sums all pairwise products in time linear in
the vector's length.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (a documented bound; the
rows with the smallest hash of their id, so the same rows whatever the partitions); it is
a few megabytes whatever the corpus.  Scoring reads every text, in the tasks that scan it.

Empty and null texts have the structure statistics of an empty text and get a score like any
other; repeated rows get equal scores; of texts that share a labelled id the one with the smallest
hash is learnt from; null labels and ids are not learnt from; ids labelled both ways are left out; without two different labels every score is the mean label (1 without
any).  lang, source and doc_id are never read for a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, per_slice, text_bytes
from sparkloom.llm.op9_quality_rules import _NOT_START, measure

WORDS = 1 << 15
RANK = 8
SAMPLE = 12_000
EPOCHS = 3
THRESHOLD = 0.3
STRUCTURE = 14
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def structure(text: bytes, n_chars: int | None) -> list[float]:
    """Ratios of about 0 to 1, from the measurements of one text and the length recorded for it."""
    m = measure(text)
    n, size = max(1, m["n_words"]), max(1, m["word_chars"])
    real = len(text.translate(None, _NOT_START))
    words = text.split()
    return [
        1.0,
        min(1.0, m["n_words"] / 50),
        min(2.0, np.log1p(m["n_words"]) / 8),
        min(2.0, m["word_chars"] / n / 10),
        min(1.0, m["n_symbols"] / n),
        m["n_dup_lines"] / max(1, m["n_lines"]),
        m["n_repeat_words"] / n,
        m["n_capital_words"] / n,
        len(set(words)) / n,
        min(1.0, sum(map(text.count, (b"!", b"?"))) / n),
        (len(text) - len(text.translate(None, b"0123456789"))) / size,
        min(1.0, m["n_lines"] / n),
        min(1.0, sum(w.endswith((b".", b",")) for w in words) / n),
        0.0 if n_chars is None else min(1.0, abs(n_chars - real) / max(1, real)),
    ]


assert STRUCTURE == len(structure(b"", None))


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text's vector; the structure comes first."""
    words = np.fromiter({zlib.crc32(w) % WORDS for w in set(text.lower().split())}, np.int64)
    words.sort()
    values = np.full(len(words), 1 / np.sqrt(max(1, len(words))), np.float32)
    return np.concatenate([np.arange(STRUCTURE), words + STRUCTURE]), np.concatenate([np.array(structure(text, n_chars), np.float32), values])


@dataclass
class Machine:
    """Bias, weights and factors; ``flat`` is the score of every text where nothing could be learnt."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    flat: float | None = None

    def scores(self, at: np.ndarray, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Scores of vectors that lie one after the other; ``heads`` is where each begins, and none is empty."""
        if self.flat is not None:
            return np.full(len(heads), self.flat)
        v = self.factors[at] * x[:, None]
        total = np.add.reduceat(v, heads, dtype=np.float64)
        linear = np.add.reduceat(self.weights[at] * x, heads, dtype=np.float64)
        own = np.add.reduceat(np.einsum("ij,ij->i", v, v), heads, dtype=np.float64)
        z = self.bias + linear + 0.5 * (np.einsum("ij,ij->i", total, total) - own)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 1, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss, one row at a time, in a seeded order."""
    if len(set(labels)) < 2:
        return Machine(0, np.zeros(0), np.zeros((0, 0)), float(np.mean(labels)) if labels else 1.0)
    draw = np.random.default_rng(seed)
    size = STRUCTURE + WORDS
    mean = float(np.mean(labels))
    model = Machine(np.log(mean / (1 - mean)), np.zeros(size, np.float32), draw.normal(0, 0.02, (size, RANK)).astype(np.float32))
    w, v = model.weights, model.factors
    gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1.0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            at, x = rows[k]
            f = v[at]
            fx = f * x[:, None]
            total = fx.sum(0)
            z = model.bias + float(w[at] @ x) + 0.5 * float(total @ total - (fx * fx).sum())
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]
            gb += slope * slope
            model.bias -= rate * slope / np.sqrt(gb)
            step = slope * x + decay * w[at]
            gw[at] += step * step
            w[at] -= rate * step / np.sqrt(gw[at])
            step = slope * (x[:, None] * (total - fx)) + decay * f
            gv[at] += step * step
            v[at] -= rate * step / np.sqrt(gv[at])
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def inputs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars); n_chars is null where the table has no such column."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), n_chars.alias("n_chars"))


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Vectors and labels of at most ``most`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most SAMPLE rows of 16 bytes

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, n) for t, n in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["doc_id", "label", "at", "x"])

    found = inputs(docs).join(F.broadcast(known), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars", "label"), F.struct(F.xxhash64("text"), "n_chars")).alias("r")).select("doc_id", "r.*")
    got = one.mapInArrow(per_slice(work), "doc_id long, label int, at binary, x binary")
    rows = sorted(got.collect(), key=lambda r: r.doc_id)  # a row per id of the sample, whatever repeats in documents
    return [(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.x, np.float32)) for r in rows], [r.label for r in rows]


def scored(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t, n) for t, n in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist())]
        heads = np.cumsum([0, *(len(at) for at, _ in rows[:-1])])
        score = shared.value.scores(np.concatenate([at for at, _ in rows]), np.concatenate([x for _, x in rows]), heads)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return inputs(docs).select("doc_id", "text", "n_chars", held).mapInArrow(per_slice(work), SCORED)


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(*sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
