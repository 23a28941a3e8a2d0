"""Licence scan: phrases, and an exact set-similarity join of text blocks with licence templates.

A template is a set of words.  Templates of up to ``SHORT`` different words are compared with lines, longer ones with
paragraphs (runs of lines with words), as such texts are wrapped.  A block has a template's label if it contains at
least ``PERCENT`` of every hundred of the template's words; a template of up to nine words must be there whole.

The join is exact and compares few pairs.  Words are ordered by the number of documents that hold them, rarest first,
counted over all documents.  A block that contains ``need`` of a template's ``n`` words contains one of its first
``n - need + 1`` words in that order (prefix filter), has at least ``need`` different words (length filter), and the
words found so far and those still to come must reach ``need`` at every step (positional filter).  Templates are a
fixed list, so their prefixes go to every task; texts are read where they are, and no row moves.

Null and empty texts have no words and no labels; repeated rows get equal rows; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, id_and_text, per_slice, pieces, text_bytes

PERCENT = 90
SHORT = 12
#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as the licences word them, and their labels.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"),
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    ("epl-2", "Eclipse Public License, version 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
)
#: Bytes of words keep their place (A-Z in lower case), line ends too; all others become blanks.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or b == 0x0A else 0x20 for b in range(256))
_BLANK_LINES = re.compile(rb"\n[ \n]*\n")
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
MATCHES = "doc_id long, kind string, block long, template int, label string, n_block long, n_shared long, containment double"


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


@dataclass(frozen=True)
class Template:
    """Its words in the global order, and how many of them a block must contain."""

    number: int
    label: str
    words: tuple[bytes, ...]
    need: int


@dataclass(frozen=True)
class Index:
    """Word -> (template, place) of the templates' prefixes; one index for lines and one for paragraphs."""

    by_word: dict[bytes, list[tuple[Template, int]]]

    def matches(self, block: set[bytes]) -> list[tuple[Template, int]]:
        """Templates that the block contains, with the number of shared words; every pair is decided once."""
        first: dict[Template, int] = {}
        for word in block & self.by_word.keys():
            for template, place in self.by_word[word]:
                if len(block) >= template.need:
                    first[template] = min(place, first.get(template, place))
        out = []
        for template, place in first.items():
            shared, left = 0, len(template.words) - place
            for word in template.words[place:]:
                if shared + left < template.need:
                    break
                shared, left = shared + (word in block), left - 1
            if shared >= template.need:
                out.append((template, shared))
        return out


def template_words(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(folded(text.encode()).split())) for label, text in templates]


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def indexes(frequency: dict[bytes, int], templates=TEMPLATES, percent: int = PERCENT) -> tuple[Index, Index]:
    """Indexes for lines and for paragraphs, words in the order of their frequency."""
    parts: tuple[dict, dict] = {}, {}
    for k, (label, words) in enumerate(template_words(templates)):
        need = needed(len(words), percent)
        template = Template(k, label, tuple(sorted(words, key=lambda w: (frequency.get(w, 0), w))), need)
        for place, word in enumerate(template.words[: len(words) - need + 1]):
            parts[len(words) > SHORT].setdefault(word, []).append((template, place))
    return Index(parts[0]), Index(parts[1])


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of the templates stands; as many rows as the templates have words."""
    wanted = frozenset().union(*(words for _, words in template_words(templates)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute

        found: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                for text in text_bytes(part.column(1)):
                    found.update(wanted.intersection(folded(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = id_and_text(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def block_matches(text: bytes, lines: Index, paragraphs: Index) -> Iterator[tuple[str, int, int, Template, int]]:
    """(kind, block, its number of different words, template, shared words); blocks are numbered from 0 within a kind."""
    held = set(text.split())
    for kind, index, cut in (("line", lines, re.compile(b"\n")), ("paragraph", paragraphs, _BLANK_LINES)):
        if held.isdisjoint(index.by_word.keys()):
            continue
        for k, block in enumerate(cut.split(text)):
            words = set(block.split())
            for template, shared in index.matches(words):
                yield kind, k, len(words), template, shared


def places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    row, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        wanted, at = b" " + phrase.encode() + b" ", -1
        upto, n = 0, 0
        while (at := row.find(wanted, at + 1)) >= 0:
            n += row.count(b" ", upto, at)
            upto = at
            out.append((n, label))
    return out


def template_matches(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """A row for each block and template that it contains, over the whole texts."""
    lines, paragraphs = indexes(word_frequencies(docs, templates), templates, percent)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [
            (doc, kind, block, t.number, t.label, n, shared, shared / len(t.words))
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)))
            for kind, block, n, t, shared in block_matches(folded(text), lines, paragraphs)
        ]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in MATCHES.split(", ")]) if rows else None

    return id_and_text(docs).mapInArrow(per_slice(work), MATCHES)


def scanned(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Per document: words, the phrases' places, labels of the phrases and of both, the highest containment (1 for a phrase)."""
    lines, paragraphs = indexes(word_frequencies(docs, templates), templates, percent)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in map(folded, text_bytes(batch.column(1))):
            words = text.split()
            base = places(words)
            found = list(block_matches(text, lines, paragraphs))
            starts, labels = [p for p, _ in base], {label for _, label in base}
            score = max([shared / len(t.words) for *_, t, shared in found] + [1.0 if base else 0.0])
            both = labels | {t.label for *_, t, _ in found}
            rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), score, len({x[:2] for x in found})))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCANNED.split(", ")])

    return id_and_text(docs).mapInArrow(per_slice(work), SCANNED)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _sql() -> str:
    """Every block against every template, without filters."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    gap = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
    templates = ", ".join(f"({k}, '{label}', {len(words)}, {needed(len(words))}, {len(words) > SHORT}, {[w.decode() for w in sorted(words)]})" for k, (label, words) in enumerate(template_words()))
    at = {p: " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split())) for p in PHRASES}
    hits = " UNION ALL ".join(f"SELECT k, '{label}' AS label, unnest(list_filter(range(1, len(ws) + 1), lambda i: {at[p]})) - 1 AS p FROM d" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {low} AS low, regexp_extract_all({low}, '{word}') AS ws FROM documents),
h AS ({hits}),
b AS (SELECT k, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY k),
t AS (SELECT * FROM (VALUES {templates}) x(t, label, n, need, long, ws)),
tw AS (SELECT t, unnest(ws) AS w FROM t),
s AS (SELECT k, FALSE AS long, unnest(string_split(low, chr(10))) AS body FROM d
      UNION ALL SELECT k, TRUE, unnest(string_split_regex(low, '{gap}')) FROM d),
sb AS (SELECT row_number() OVER () AS s, k, long, list_distinct(regexp_extract_all(body, '{word}')) AS ws FROM s),
sw AS (SELECT s, unnest(ws) AS w FROM sb),
c AS (SELECT s, t, count(*) AS shared FROM sw JOIN tw USING (w) GROUP BY s, t),
m AS (SELECT sb.k, sb.s, t.label, shared / n::DOUBLE AS score FROM c JOIN sb ON sb.s = c.s JOIN t ON t.t = c.t AND t.long = sb.long WHERE shared >= need),
ml AS (SELECT k, max(score) AS score, count(DISTINCT s) AS n_blocks FROM m GROUP BY k),
l AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM m UNION ALL SELECT k, label FROM h) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN b ON b.k = d.k LEFT JOIN ml ON ml.k = d.k LEFT JOIN l ON l.k = d.k
"""


OP12_SQL = _sql()
