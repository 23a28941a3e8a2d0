"""Terms of any number of words in texts: one pass per text over an automaton of folded words, or over a filter of runs
where there are too many terms for one."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparkloom.functions import text
from sparkloom.functions.batches import in_parts

NOT_WORD = r"[^\p{L}\p{N}_]+"


def words(column: Column) -> Column:
    """The folded words of a text."""
    return F.filter(F.split(text.folded(column), NOT_WORD), lambda w: w != "")


class Automaton:
    """States are beginnings of terms.  ``fall`` leads to the longest other beginning that ends alike, ``ends`` holds
    the terms that end in a state, those of its falls included, so that terms within and across others are found."""

    def __init__(self, terms: Iterable[tuple[str, ...]]):
        self.step: list[dict[str, int]] = [{}]
        self.fall: list[int] = [0]
        self.ends: list[tuple[int, ...]] = [()]
        for number, term in enumerate(terms):
            state = 0
            for word in term:
                if word not in self.step[state]:
                    self.step[state][word] = len(self.step)
                    self.step.append({})
                    self.fall.append(0)
                    self.ends.append(())
                state = self.step[state][word]
            if state:
                self.ends[state] += (number,)
        waiting = deque(self.step[0].values())
        while waiting:
            state = waiting.popleft()
            for word, to in self.step[state].items():
                self.fall[to] = self._next(self.fall[state], word)
                self.ends[to] += self.ends[self.fall[to]]
                waiting.append(to)

    def _next(self, state: int, word: str) -> int:
        while state and word not in self.step[state]:
            state = self.fall[state]
        return self.step[state].get(word, 0)

    def found(self, text_words: list[str]) -> set[int]:
        """The terms that stand in a text, by number."""
        out: set[int] = set()
        state, first, step, ends = 0, self.step[0], self.step, self.ends
        for word in text_words:
            state = self._next(state, word) if state else first.get(word, 0)
            if state and ends[state]:
                out.update(ends[state])
        return out


def finder(automaton: Automaton):
    """A column function: the numbers of the terms in a text that ``spaced`` has prepared."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def terms_in(column: pa.Array) -> pa.Array:
        return in_parts(column, lambda t: None if t is None else sorted(automaton.found(t.split(" "))), pa.list_(pa.int32()))

    return terms_in


def spaced(column: Column) -> Column:
    """Folded words between single blanks; the folding stays in generated code."""
    return F.regexp_replace(text.folded(column), NOT_WORD, " ")


def runs(column: Column, lengths: Iterable[int]) -> Column:
    """Runs of neighbouring words of the given lengths, each as words between blanks."""
    def of(w: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i + n - 1 <= F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    def all_of(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.array_distinct(F.concat(*(of(w, n) for n in sorted(lengths))))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words(column)), all_of), 1)  # the text is split once, not for each run


# ------------------------------------------------------------------ large vocabularies

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_SLICE = 1 << 18  # bytes of text
_BYTES = np.random.default_rng(1).integers(1 << 63, size=256, dtype=np.uint64)
_END = np.uint64(0x9E3779B97F4A7C15)  # tells a whole term from a beginning of one


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Words:
    """The words of some texts: where each starts and ends in ``blob``, its text's number, and its hash."""

    def __init__(self, texts: list[bytes]):
        self.blob = b" ".join([*texts, b""])
        data = np.frombuffer(self.blob, np.uint8)
        within = np.concatenate(([False], data != 32, [False]))
        self.starts = np.flatnonzero(within[1:] & ~within[:-1])
        self.ends = np.flatnonzero(~within[1:] & within[:-1])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        offset = np.arange(size.sum()) - np.repeat(first, size)
        power = np.cumprod(np.full(max(int(size.max(initial=0)), 1), 0x100000001B3, np.uint64))
        values = _BYTES[data[np.repeat(self.starts, size) + offset]] * power[offset]
        self.hashes = _mixed(np.add.reduceat(values, first)) if len(first) else np.zeros(0, np.uint64)

    def longer(self, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places whose runs of n - 1 words have another word in their text, and the hashes of n words."""
        last = at + (n - 1)
        there = last < len(self.text)
        there[there] = self.text[last[there]] == self.text[at[there]]
        return at[there], _mixed(h[there] + self.hashes[last[there]])


def _slices(column: pa.Array | pa.ChunkedArray):
    """The texts in parts of about ``_SLICE`` bytes; a null is an empty one."""
    part, size = [], 0
    for k in range(0, len(column), 64):
        for text_ in column.slice(k, 64).cast(pa.binary()).to_pylist():
            part.append(text_ or b"")
            size += len(part[-1])
            if size >= _SLICE:
                yield part
                part, size = [], 0
    yield part


def _marks(h: np.ndarray, n_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of 64 bits that a hash has in a filter, and its bits there, at most k of them."""
    bits = np.zeros(len(h), np.uint64)
    for shift in range(64 - 6 * k, 64, 6):
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return h & np.uint64(n_words - 1), bits


def run_filter(terms: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of terms (a column of words between blanks; about n of them) and of their beginnings, as words of 64
    bits, and how many bits each marks in its word.  It has at most ``MOST_BITS``, however many terms there are: more of them
    let more runs through."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * n - 1).bit_length()))
    n_words, k = bits // 64, max(1, min(4, bits // (8 * max(n, 1))))

    def marked(batches):
        for batch in batches:
            for part in _slices(batch.column(0)):
                words_ = _Words(part)
                count = np.bincount(words_.text, minlength=len(part))
                at = np.flatnonzero(np.concatenate(([True], words_.text[1:] != words_.text[:-1]))) if len(words_.text) else np.zeros(0, np.int64)
                h, size, found = words_.hashes[at], 1, [np.zeros(0, np.uint64)]
                while len(at):
                    found.append(np.where(count[words_.text[at]] == size, h ^ _END, h))
                    size += 1
                    at, h = words_.longer(at, h, size)
                word, marks_ = _marks(np.unique(np.concatenate(found)), n_words, k)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(marks_.view(np.int64))], ["word", "bits"])

    marks = terms.mapInArrow(marked, "word long, bits long")
    rows = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64
    out = np.zeros(n_words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64), k


def likely_runs(filter_, longest: int):
    """For ``mapInArrow`` over ids and columns of texts that ``spaced`` has prepared: the runs, of at most ``longest`` words,
    that a broadcast filter lets through: all terms that stand in the texts, and some others.

    A row is (run, number of the column, ids): a run's words are written once for a batch of texts, not once for each, and
    its ids are at most a batch's.  A text's run counts in the first column that has it.
    """

    def known(h: np.ndarray) -> np.ndarray:
        table, k = filter_.value
        word, bits = _marks(h, len(table), k)
        return table[word] & bits == bits

    def rows_of(column: pa.Array) -> dict[bytes, list[int]]:
        """Runs and the places of their texts, each place once, in order."""
        out: dict[bytes, list[int]] = {}
        first = 0
        for part in _slices(column):
            words_ = _Words(part)
            at, h = np.arange(len(words_.hashes)), words_.hashes
            for n in range(1, longest + 1):
                if n > 1:
                    at, h = words_.longer(at, h, n)
                whole = at[known(h ^ _END)]
                for k, a, b in zip((words_.text[whole] + first).tolist(), words_.starts[whole].tolist(), words_.ends[whole + (n - 1)].tolist()):
                    rows = out.setdefault(words_.blob[a:b], [])
                    if not rows or rows[-1] != k:
                        rows.append(k)
                begun = known(h)
                at, h = at[begun], h[begun]
            first += len(part)
        return out

    def runs_in(batches):
        for batch in batches:
            ids, *columns = batch.columns
            before: dict[bytes, set[int]] = {}
            for number, column in enumerate(columns):
                found = rows_of(column)
                for run in before.keys() & found.keys():
                    found[run] = [k for k in found[run] if k not in before[run]]
                    before[run].update(found[run])
                lists = [np.array(rows, np.int64) for rows in found.values()]
                ends = np.cumsum([0, *map(len, lists)])
                runs_ = pa.array(found.keys(), pa.binary(), size=len(found)).cast(pa.string())
                own = ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
                yield pa.RecordBatch.from_arrays([runs_, pa.array(np.full(len(found), number, np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], ["w", "place", "idx"])
                if number + 1 < len(columns):
                    for run in found.keys() - before.keys():
                        before[run] = set(found[run])

    return runs_in
