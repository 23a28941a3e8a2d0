"""WARC, audio, packing and token operators: round trips and plain versions."""

import base64
import gzip
import hashlib
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import op1_warc, op2_telephony, op3_packing, op5_byte_bpe, op10_bfd, wordbpe

ODD = ["ΑΣ ΣΑΣ. İstanbul ǅ", "it's don't WE'LL x'ré", "\x1c\x1d a\x85b\xa0c d", "", "  ", " <|endoftext|> x", "é é ﬁ", "½²³ ªº 12,345", "a\tb\r\nc\x0bd\x0c", "日本語テキスト　です", "​zero­soft", "'s's 'tis", "x" * 3000, "a " * 9000, "no-space" * 4000]
ROWS = [(k, t) for k, t in enumerate(ODD)] + [(900, None), (None, "id-less"), (7, "again"), (7, "again")]


# ------------------------------------------------------------------ WARC


class Plain(HTMLParser):
    """What a page says, by the library's parser, for pages whose elements are all closed."""

    def __init__(self, source):
        super().__init__()
        self.off, self.lines, self.links, self.title, self.language, self.in_title = 0, [""], [], None, None, False
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        self.off += tag in (*op1_warc.DROPPED, "head")
        if tag == "html" and self.language is None:
            self.language = (values.get("lang") or "").lower() or None
        if tag == "a" and (values.get("href") or "").strip() and values["href"].strip() not in self.links:
            self.links.append(values["href"].strip())
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag in op1_warc.LINES:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.off -= tag in (*op1_warc.DROPPED, "head")
        self.in_title = self.in_title and tag != "title"
        if tag in op1_warc.LINES:
            self.lines.append("")

    def handle_comment(self, data):
        self.handle_data(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.off:
            first, *more = data.split("\n")
            self.lines[-1] += first
            self.lines += more

    def text(self):
        lines = [" ".join(re.split(r"[ \t\r\f\v\xa0]+", x)).strip() for x in [self.title or "", *self.lines]]
        return "\n".join(x for x in lines if x)


def test_warc_derivatives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = op1_warc.derivatives(op1_warc.captured(pages), keep_records=True).collect()
    source = {r.page_id: r for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        page = source[r.page_id]
        body = page.html.encode()
        assert r.response_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        (meta, about), (conv, text) = (next(op1_warc.read_records(x)) for x in (r.metadata_member, r.conversion_member))
        assert gzip.decompress(r.metadata_member).decode() == r.metadata_record and gzip.decompress(r.conversion_member).decode() == r.conversion_record
        assert (meta["warc-type"], conv["warc-type"]) == ("metadata", "conversion")
        assert meta["warc-refers-to"] == conv["warc-refers-to"] == r.response_id and conv["warc-refers-to-target-uri"] == page.url
        assert conv["warc-payload-digest"] == op1_warc.digest(text) and conv["warc-source-payload-digest"] == r.response_payload_digest
        assert f"source-payload-digest: {r.response_payload_digest}\r\n".encode() in about and about.decode().startswith(r.source_headers)
        assert r.source_headers == f"http-status: HTTP/1.1 200 OK\r\nhttp-content-type: text/html; charset=utf-8\r\nhttp-content-length: {len(body)}\r\n"
        assert len(text) == r.n_text_bytes and hashlib.sha256(text).hexdigest() == r.text_sha256
        plain = Plain(page.html)
        assert (r.title, r.language, r.links, r.n_links) == (plain.title and " ".join(plain.title.split()), plain.language, plain.links, len(plain.links))
        assert text.decode() == plain.text()
    assert len({r.response_id for r in rows}) == len({(r.page_id) for r in rows})


def test_warc_edges_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p>a<p>b &lt;c&gt;<script>x")], "page_id long, url string, html string")
    rows = op1_warc.derivatives(op1_warc.captured(df)).collect()
    assert len(rows) == 4 and Counter(r.response_id for r in rows).most_common(1)[0][1] == 2
    assert op1_warc.read_page("<p>a<p>b &lt;c&gt;<script>x").text == "a\nb <c>"
    assert op1_warc.read_page("<head><title>t</title><style>s</style><body>a &#" + "9" * 9000 + "; <b>b</b> <").text == "t\na \ufffd b <"
    assert op1_warc.derivatives(op1_warc.captured(df.limit(0))).count() == 0
    odd = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    cut = op1_warc.response(1, "u", b"<p>x")[:-9]
    broken = spark.createDataFrame([(1, odd), (2, b"junk"), (3, None), (4, cut), (5, b"\x1f\x8bjunk"), (6, b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\n")], "page_id long, record binary")
    assert op1_warc.derivatives(broken).count() == 0
    for name in ("idna", "rot13", "undefined", "utf-16", "no-such"):
        assert "a" in op1_warc.decoded("<p>a".encode("utf-16" if name == "utf-16" else "utf-8"), f"text/html; charset={name}")


def test_warc_files_are_read_in_ranges(spark, tmp_path):
    inner = op1_warc.response(9, "http://inner", b"<p>inside")
    bodies = [b"<title>t</title>" + b"<p>x" * (k % 700) + (inner if k == 20 else b"") for k in range(600)]
    records = [op1_warc.response(k, f"http://x/{k}", b) for k, b in enumerate(bodies)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:50]))
    expected = Counter(op1_warc.digest(b) for b in bodies + bodies[:50])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
        got = op1_warc.read_warc(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert Counter(r.response_payload_digest for r in op1_warc.derivatives(got).collect()) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("part", ["<a ", "<title>", "<!-- ", "<script>", "<p", "&#1", "<a href=", '<a href="', "</p  ", "<html lang ", "<a" + " " * 50])
def test_pages_are_read_in_linear_time(part):
    began = time.perf_counter()
    op1_warc.read_page(part * (5_000_000 // len(part)) + ">")
    assert time.perf_counter() - began < 10


# ------------------------------------------------------------------ audio


def slow_adpcm(block):
    value, step = struct.unpack("<hB", block[:3])
    step %= 89
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            size = int(op2_telephony.STEPS[step])
            change = size >> 3
            change += size * (code >> 2 & 1) + (size >> 1) * (code >> 1 & 1) + (size >> 2) * (code & 1)
            value = max(-32768, min(32767, value + (-change if code & 8 else change)))
            step = max(0, min(88, step + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    data = np.random.default_rng(1).integers(0, 256, 64 * 40).astype(np.uint8)
    got = op2_telephony.decode_adpcm(data)
    assert [list(r) for r in got] == [slow_adpcm(bytes(b)) for b in data.reshape(-1, 64)]


def test_companding_tables():
    mu, a = op2_telephony.MU_TABLE, op2_telephony.A_TABLE
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_audio_rows(frame):
    rows = {}
    for r in op2_telephony.decode_columns(frame(ROWS), keep_media=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, text in ROWS:
        if i == 7:
            continue
        body = (text or "").encode()
        padded = body + bytes(-len(body) % 64 if body else 64)
        r = rows[i][0]
        code, rate, back = op2_telephony.read_wave(bytes(r.media))
        assert (code, rate, back) == (7, 8000, padded) and len(r.media) == r.media_bytes
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        code, rate, pcm = op2_telephony.read_wave(bytes(r.pcm))
        assert (code, rate, len(pcm)) == (1, 16000, 4 * len(padded))
    assert op2_telephony.decode_columns(frame([])).count() == 0


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_word_cache_equals_library(library):
    words = wordbpe.Words(public_tokenizers.path(wordbpe.VOCABULARY), most=50)
    for text in ODD * 2:
        assert list(struct.unpack(f"<{len(words.packed(text)) // 4}I", words.packed(text))) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_cache_equals_library_on_any_text(text):
    from tokenizers import Tokenizer

    words = wordbpe.words()
    ids = words.full.encode(text, add_special_tokens=False).ids
    assert words.packed(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .,'\n\té　\x1c"), max_size=80))
def test_cuts_keep_ids(text):
    assert op5_byte_bpe.encode(text, None, 3) == op5_byte_bpe.encoding().encode_ordinary(text)


def test_byte_bpe_rows(frame):
    got = defaultdict(list)
    for r in op5_byte_bpe.encode_and_decode(frame(ROWS), most=500).collect():
        got[r.doc_id].append(r)
    code = op5_byte_bpe.encoding()
    for i, text in ROWS:
        if i == 7:
            continue
        ids = code.encode_ordinary(text or "")
        r = got[i][0]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert sum(map(len, got.values())) == len(ROWS)


def slow_place(counts, size, length):
    """The level whose window, with ``length`` more, makes the sum of squares smallest; -1 for a new window."""
    def total(c):
        return sum(n * n for h, n in c.items() if 0 < h < size)

    best = []
    for h in [-1, *(h for h in counts if counts[h] and h + length <= size)]:
        c = Counter(counts)
        if h >= 0:
            c[h] -= 1
        c[max(h, 0) + length] += 1
        best.append((total(c), -h if h >= 0 else 1, h))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_sum_of_squares_choices(lengths):
    levels, counts = op3_packing.Levels(16), Counter()
    for length in lengths:
        options = slow_place(counts, 16, length)
        window, h = levels.place(length)
        least = min(o[0] for o in options)
        assert least in [o[0] for o in options if o[2] == (h if h else -1)]
        if h:
            counts[h] -= 1
        counts[h + length] += 1
        assert {k: n for k, n in counts.items() if n and k < 16} == {k: int(n) for k, n in enumerate(levels.count) if n}


def check_pieces(pieces, expected, size):
    """Each id lies in exactly one piece, and sequences have no gaps, no overlaps and no padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, ids, sequence, offset in pieces:
        docs[doc].append((start, ids))
        sequences[sequence].append((offset, len(ids) // 4))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in docs.items()} == expected
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_packer_loses_nothing(lengths):
    packer, out = op3_packing.Packer(32), []
    docs = {k: struct.pack(f"<{n}I", *range(n)) for k, n in enumerate(lengths)}
    for k, ids in docs.items():
        out += packer.add(k, ids)
    out += packer.close()
    check_pieces([(d, s, p, w, o) for d, s, p, _, w, o in out], docs, 32)


def test_packing_rows(frame, library):
    rows = op3_packing.pack(frame(ROWS)).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    for i, text in ROWS:
        if i == 7:
            continue
        ids = [*library(text or ""), 2]
        parts = sorted(per[i], key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1]) and sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in parts)
    assert sum(r.start == 0 for r in per[7]) == 3 and op3_packing.pack(frame([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_equals_plain_best_fit(lengths):
    rows, rooms = [], []
    for part in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fitting = [r for r in rooms if r >= lengths[part]]
        room = min(fitting) if fitting else 20
        if fitting:
            rooms.remove(room)
        rooms.append(room - lengths[part])
    rows = op10_bfd.best_fit(lengths, 20)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert sorted(20 - sum(lengths[k] for k in r) for r in rows) == sorted(rooms)


def test_matrices(frame, library):
    texts = {i: t for i, t in ROWS if i != 7}
    found = defaultdict(dict)
    files = op10_bfd.pack(frame(list(texts.items())), size=64, shard=2000, files=True).collect()
    rows = op10_bfd.pack(frame(list(texts.items())), size=64, shard=2000).collect()
    assert sum(f.n_rows for f in files) == len(rows)
    order = iter(sorted(rows, key=lambda r: r.sequence_id))
    for f in sorted(files, key=lambda f: f.shard_id):
        ids = np.frombuffer(f.ids, "<u4").reshape(f.n_rows, 64)
        places = np.frombuffer(f.positions, "<u4").reshape(f.n_rows, 64)
        for k in range(f.n_rows):
            cuts, row = f.cu_seqlens[f.row_starts[k] : f.row_starts[k + 1]], next(order)
            assert cuts == row.cu_seqlens and zlib.crc32(ids[k].tobytes()) == row.ids_crc32 and zlib.crc32(places[k].tobytes()) == row.positions_crc32
            assert ids[k].tobytes() == row.ids and places[k].tobytes() == row.positions
            for doc, start, a, b in zip(row.doc_ids, row.starts, cuts, cuts[1:]):
                assert places[k, a:b].tolist() == list(range(b - a))
                found[doc][start] = ids[k, a:b].tolist()
            assert row.n_pad == 64 - cuts[-1] and not ids[k, cuts[-1] :].any()
    for i, text in texts.items():
        assert [x for s in sorted(found[i]) for x in found[i][s]] == [*library(text or ""), 2]
    assert op10_bfd.pack(frame([])).count() == 0
