"""Token ids by a tokenizers file, each distinct piece of a worker's texts encoded once."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import pieces, text_buffers

#: Pieces in one generation of the memo; when it is full the pieces still met move on into a new one.
MEMO = 120_000
#: Texts whose chunks are told apart at once, in bytes.
SLICE = 4 << 20
#: Texts with runs of spaces are cut into parts of about so many characters, each before a space that follows another sign.
PART = 1 << 13
#: Where the two kinds of rules cut. Letters and numbers that these name otherwise than the rules do are told when a piece is first met.
CUTS = {
    "before": re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "at": re.compile(r"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}
#: White space for this regular expression engine only.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WIDE_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class NotPlain(ValueError):
    """A piece whose ids only the library tells, in its context."""


def _byte_alphabet() -> dict[int, str]:
    """How byte-level tokenizers spell bytes: printable ones as themselves, the others in order from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """`text` in parts of `size` characters or more, each but the first from a space on that another sign precedes: the rules cut there."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=1 << 16)
def _kind(sign: str) -> str:
    """letter, digit or other, if all engines agree on it since they have long known the sign; else odd. A final sigma depends on its place."""
    settled = unicodedata.category(sign) == unicodedata.ucd_3_2_0.category(sign) != "Cn"
    if not settled or sign == "\u03a3":
        return "odd"
    if sign.isalpha():
        return "letter" if unicodedata.category(sign)[0] == "L" else "odd"
    return ("digit" if sign.isdecimal() else "odd") if sign.isalnum() else "other"


def _classes() -> np.ndarray:
    """What a byte tells of its sign: 0 white space, 1 letter, 2 digit, 3 other, 4 not known alone."""
    out = np.full(256, 4, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if chr(b) == "'" else 3
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


_CLASSES = _classes()


def tiles(off: np.ndarray, raw: np.ndarray, digits_alone: bool) -> np.ndarray:
    """Where the texts raw[off[i]:off[i+1]] (UTF-8) may be cut into parts that are encoded alone: the parts' first bytes.

    A part is a run of letters, of digits or of other signs, with a space before it; a run of white space is cut before
    its last sign if something follows. Strings between white space with signs whose class their bytes don't tell, or
    with an apostrophe, stay whole. The only white space told is that of one byte.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASSES[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    first = np.zeros(n + 1, bool)
    first[off] = True
    space = kind == 0
    cut = np.empty(n, bool)
    cut[0] = True
    p, q = space[:-1], space[1:]
    inner = ~p & ~q & (kind[1:] != kind[:-1])
    if digits_alone:
        inner |= (kind[1:] == 2) & (kind[:-1] == 2)
    # strings between white space, and whether one has a sign of class 4
    starts = np.flatnonzero(~space & (np.concatenate([[True], p]) | first[:-1]))
    if len(starts):
        whole = np.maximum.reduceat(kind, starts) == 4
        at = np.flatnonzero(inner)
        inner[at[whole[np.searchsorted(starts, at + 1, "right") - 1]]] = False
    follows = np.append(~q & ~first[1:-1], False)[1:]
    cut[1:] = inner | (~p & q) | (p & q & follows) | (p & ~q & (raw[:-1] != 0x20))
    cut |= first[:-1]
    return np.flatnonzero(cut)


class _Memo(dict):
    """part -> its ids' bytes. A full generation becomes the older one, from which pieces are taken over when met again."""

    def __init__(self, make, size: int | None):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > (self.size or MEMO):
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        self[piece] = ids = self.make(piece) if ids is None else ids
        return ids


class Encoder:
    """encode(texts) gives the ids of a column of texts, one after the other, and where each text's begin.

    split tells by which rules the tokenizer cuts, so that parts may be encoded alone:
    "before" - byte-level rules where a space goes with the word after it,
    "at" - rules that lower-case, drop white space and take digits one by one,
    "" - others; whole texts are encoded.

    Texts are cut where both kinds of rules cut too (`tiles`); of the distinct tiles of a slice of texts the new ones go to
    the model, and the texts' ids are then gathered by numbers of tiles.
    """

    def __init__(self, path: str, split: str, memo: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = split
        self.model = self.tokenizer.model
        self.cuts = CUTS.get(split)
        self.spelling = _byte_alphabet()
        self.memo = _Memo(self._part, memo)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of what the rules never cut: straight from the model."""
        x = piece.lower() if self.split == "at" else piece
        if not piece.isascii():
            kinds = set(map(_kind, x[1:] if x[0] == " " else x))
            if len(kinds) > 1 or "odd" in kinds or x is not piece and set(map(_kind, piece)) != kinds:
                raise NotPlain(piece)
        return array("I", [t.id for t in self.model.tokenize("".join(map(self.spelling.__getitem__, x.encode())))]).tobytes()

    def _part(self, text: str) -> bytes:
        """The ids of a part of a text."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and word.isascii():
            if self.split == "at":  # ASCII letters are spelled as themselves
                return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
            return self._piece(text)
        if not text.isascii() and self.split == "at" and not unicodedata.is_normalized("NFC", text) or _ODD_SPACE.search(text):
            return self._library(text)
        try:
            return b"".join(map(self._piece, self.cuts.findall(text)))
        except NotPlain:
            return self._library(text)

    def _rows(self, texts: list[str]) -> list[bytes]:
        if self.cuts is None:
            return [self._library(t) for t in texts]
        return [b"".join(map(self._part, parts_of(t))) if t else b"" for t in texts]

    def _slice(self, off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of each text's ids, and the ids."""
        edges = tiles(off, raw, self.split == "at")
        offsets = np.append(edges, len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(edges), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        found = list(map(self.memo.__getitem__, words.dictionary.to_pylist()))
        at = words.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.concatenate([[0], np.cumsum(size)])
        own = size[at]
        end = np.concatenate([[0], np.cumsum(own)])
        ids = np.frombuffer(b"".join(found), np.uint32)[np.repeat(start[at] - end[:-1], own) + np.arange(end[-1])]
        return np.diff(end[np.searchsorted(edges, off)]), ids

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one number more than texts), and all ids, unsigned 32-bit. A null is an empty text."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        column = column.fill_null("")
        slow = np.full(len(column), True) if self.cuts is None else pc.match_substring_regex(column, _WIDE_SPACE).to_numpy(zero_copy_only=False) if self.split == "before" else np.zeros(len(column), bool)
        sizes, flat = [np.zeros(1, np.int64)], []
        off, raw = text_buffers(column)
        for a, b in pieces(off, SLICE):
            # runs of texts that are cut alike
            edges = [a, *(a + 1 + np.flatnonzero(np.diff(slow[a:b]))).tolist(), b]
            for i, j in zip(edges, edges[1:], strict=False):
                if slow[i]:
                    rows = self._rows(column.slice(i, j - i).to_pylist())
                    size, ids = np.array([len(x) // 4 for x in rows], np.int64), np.frombuffer(b"".join(rows), np.uint32)
                else:
                    size, ids = self._slice(off[i : j + 1] - off[i], raw[off[i] : off[j]])
                sizes.append(size)
                flat.append(ids)
        return np.cumsum(np.concatenate(sizes)), np.concatenate(flat) if flat else np.zeros(0, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str, split: str, memo: int | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(path, split, memo)
