"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before encoding: a place after a letter, digit or comma or stop and
before a space.  No match of the split pattern holds a character that is not white space
followed by white space, so a match always ends there, and the ids of the parts, one after
the other, are those of the whole.  A text with no such place is encoded in one part.

Decoding joins the raw bytes of the ids.  Null texts count as empty; repeated rows and ties
give equal values; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import documents, id_and_text, per_slice

RANKS = "byte_bpe_multi_50k.tiktoken"
PART = 16_384  # characters; longer texts are cut
_SAFE = regex.compile(r"(?<=[A-Za-z0-9.,])(?= )")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_parts int"


@functools.cache
def encoding(path: str | None = None):
    """The encoding of a rank file, read once in each worker process."""
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at safe boundaries alone."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str | None = None, most: int = PART) -> list[int]:
    code = encoding(path).encode_ordinary
    if len(text) <= most:
        return code(text)
    return [i for part in parts(text, most) for i in code(part)]


def encode_and_decode(docs: DataFrame, ranks: str | None = None, most: int = PART) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, out = encoding(ranks), []
        for text in batch.column(1).to_pylist():
            ids = encode(text, ranks, most)
            out.append((len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(code.decode_bytes(ids)).hexdigest(), 1 if len(text) <= most else sum(1 for _ in parts(text, most))))
        n, ids, back, cut = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(cut, pa.int32())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_parts"])

    return id_and_text(docs).mapInArrow(per_slice(work), SCHEMA)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir))
