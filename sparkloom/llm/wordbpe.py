"""Ids of the word-level BPE vocabulary, piece by piece with a bounded cache.

The tokenizer drops white space and cuts words into pieces (runs of letters, single digits, runs of
other characters) before its merges, so the ids of a text are the ids of its pieces, one after the
other.  Each distinct piece is merged once (by the library's own BPE model) and kept as packed
little-endian ids, and so are words of several pieces; a text's ids are then a join of cached bytes.
Texts of plain Latin-1 characters are cut as bytes; words with others go to the whole library.
"""

from __future__ import annotations

import functools
import re
import struct

import public_tokenizers
import regex

VOCABULARY = "word_bpe_49k.json"
END = struct.pack("<I", 2)
CACHE = 1_200_000  # words and pieces
LONGEST = 256  # bytes of one that is kept: with their number, a bound of the cache
#: Characters in NFC that Python and the library put in lower case alike, in Latin-1.
_PLAIN = bytes([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB5), *range(0xB6, 0x100)])
_BLANKS = b" \n"
_LOWER = bytes(ord(c.lower()) if bytes([ord(c)]) in _PLAIN and len(c.lower()) == 1 else ord(c) for c in map(chr, range(256)))
#: Pieces of lower-case plain characters: letters, contractions, a digit, anything else but blanks.
_PIECE = re.compile(rb"[a-z\xaa\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \na-z\xaa\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself if printable, else 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """Word or piece, in lower-case Latin-1 -> packed ids, filled as they are asked for; emptied when it holds ``most``."""

    def __init__(self, merge, most: int):
        self.merge, self.most, self.letters = merge, most, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        parts = _PIECE.findall(word)
        if len(parts) > 1:
            packed = b"".join(map(self.__getitem__, parts))
        else:
            text = word.decode() if word.isascii() else word.decode("latin-1").encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.merge(text)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


class Words(dict):
    """Word -> packed ids, for words with characters that are not plain; bounded like ``Pieces``."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.most = most
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.pieces = Pieces(self.full.model.tokenize, most)

    def __missing__(self, word: str) -> bytes:
        if (packed := self.plain(word)) is not None:
            return packed
        ids = self.full.encode(word, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed

    def plain(self, text: str) -> bytes | None:
        """The ids of a text of plain characters and blanks; None for any other."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if data.translate(None, _PLAIN + _BLANKS):
            return None
        return b"".join(map(self.pieces.__getitem__, data.translate(_LOWER).split()))

    def packed(self, text: str) -> bytes:
        """The text's ids, each as four little-endian bytes, without the end id."""
        if (packed := self.plain(text)) is not None:
            return packed
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def words(path: str | None = None, most: int = CACHE) -> Words:
    """One cache for each worker process; the path is a parameter, the file stays where it is."""
    return Words(path or public_tokenizers.path(VOCABULARY), most)
