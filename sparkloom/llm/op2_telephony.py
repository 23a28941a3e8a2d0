"""Telephony audio columns: companded and ADPCM-coded bytes to resampled PCM.

The payload of a row is stored without loss as 8-bit samples of a RIFF/WAVE file of format 7
(mu-law, 8 kHz, one channel).  Reading parses the file's chunks again and yields the very
bytes.  Features then come from three decoders over the bytes read back:

* mu-law and A-law expand through lookup tables of 256 entries built from their rules;
* IMA ADPCM takes the bytes as 64-byte blocks (a 4-byte head: predictor, step index, reserved;
  then 120 four-bit codes).  The codes of a block depend on each other, blocks do not, so one
  numpy step decodes code k of every block of a slice of rows at once.

The mu-law signal is resampled from 8 to 16 kHz (linear, integer arithmetic) and stored as
16-bit PCM in a WAVE file; the feature string has its CRC and the levels of all three signals.

A null text counts as empty and an empty text as one block of 64 zero bytes; equal texts give
equal values; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import documents, id_and_text, per_slice, text_bytes

BLOCK = 64
RATE = 8000
MU_LAW, A_LAW, PCM = 7, 6, 1
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
)

# Fixed values of the IMA ADPCM format: how codes move the step index, and the 89 step sizes.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int64)


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: inverted bits, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted, sign, 3 bits of exponent, 4 of mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For (step index, code): the change of the predictor, and the next step index."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + INDEX_MOVE[None, :], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), following.astype(np.int32).ravel()


_CHANGE, _NEXT = adpcm_tables()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """(blocks, 121) samples of data that is a whole number of 64-byte blocks."""
    blocks = data.reshape(-1, BLOCK)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = (blocks[:, 2].astype(np.int32) % len(STEPS)) * 16
    codes = np.empty((2 * (BLOCK - 4), len(blocks)), np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = head
    for k in range(len(codes)):
        at = index + codes[k]
        head = np.minimum(np.maximum(head + _CHANGE[at], -32768), 32767)
        index = _NEXT[at] << 4
        out[k + 1] = head
    return out.T


def upsample(x: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean (rounded down) of it and the next; the last one is held."""
    out = np.empty(2 * len(x), "<i2")
    out[0::2] = x
    following = np.append(x[1:], x[-1:]).astype(np.int32)
    out[1::2] = (x + following) >> 1
    return out


def wave(samples: bytes, code: int, rate: int, bits: int) -> bytes:
    """A RIFF/WAVE file of one channel; an odd data chunk is padded as RIFF asks."""
    width = bits // 8
    form = struct.pack("<HHIIHHH", code, 1, rate, rate * width, width, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form
    if code != PCM:
        body += b"fact" + struct.pack("<II", 4, len(samples) // width)
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(blob: bytes) -> tuple[int, int, bytes]:
    """Format code, rate and sample bytes; chunks may come in any order."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, code, rate, data = 12, 0, 0, b""
    while at + 8 <= len(blob):
        kind, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if kind == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", blob, at + 8)
        elif kind == b"data":
            data = blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return code, rate, data


def level(x: np.ndarray) -> str:
    """Mean of absolute values, peak and sign changes: integers, so alike on every machine."""
    w = x.astype(np.int32)
    return f"{int(np.abs(w).sum()) // len(w)}/{int(np.abs(w).max())}/{int(np.count_nonzero((w[1:] ^ w[:-1]) < 0))}"


def decode_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores, reads back and decodes each row; with ``keep_media`` the two WAVE files are columns too."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(batch.column(1))
        stored = [wave(b + bytes(-len(b) % BLOCK if b else BLOCK), MU_LAW, RATE, 8) for b in raw]
        back = [read_wave(m)[2] for m in stored]
        adpcm = decode_adpcm(np.frombuffer(b"".join(back), np.uint8))
        rows, at, media = [], 0, []
        for b, m, p in zip(raw, stored, back):
            samples = np.frombuffer(p, np.uint8)
            mu, n = MU_TABLE[samples], len(p) // BLOCK
            pcm = wave(upsample(mu).tobytes(), PCM, 2 * RATE, 16)
            feature = f"mu:{level(mu)};a:{level(A_TABLE[samples])};adpcm:{level(adpcm[at : at + n].ravel())};pcm16k:{zlib.crc32(pcm):08x}"
            at += n
            media.append(pcm)
            rows.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(pcm), hashlib.sha256(pcm).hexdigest()))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
        if keep_media:
            cols, names = [*cols, pa.array(stored, pa.binary()), pa.array(media, pa.binary())], [*names, "media", "pcm"]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", *names])

    return id_and_text(docs).mapInArrow(per_slice(work, 2 << 20), SCHEMA + (", media binary, pcm binary" if keep_media else ""))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_columns(documents(spark, sf_dir))
