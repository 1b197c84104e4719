"""Token ids of whole texts, with the tokenizers library, by the chunk.

Encoding text by text spends most of its time on words that it has encoded before. A text is therefore cut where
the tokenizer's own pre-tokenizer always cuts, and the ids of each distinct chunk are encoded once per Python worker
and kept as packed 32-bit ids, so that a text's ids are one join of byte strings. The memory is
bounded by two generations of ``GENERATION`` chunks, and ``AFTER_BLANK`` times as many where chunks after a blank are told apart.

Both vocabularies that are supported here are byte-level BPE, with or without white space in their pre-tokens:

* white space kept (no normalizer): a cut lies at a line end and before a blank, but inside a run of white space only
  before its last character;
* white space dropped (word ends): a cut lies at any ASCII white space.

A text that may hold an added token of the tokenizer (``<|endoftext|>``) is encoded whole, as the library reads it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Chunks of each of the two generations that a worker keeps.
GENERATION = 200_000
#: Times as many of those that follow a blank, which are nearly all where they are told apart.
AFTER_BLANK = 4
#: Longer chunks are encoded each time.
LONGEST = 48

# The white space of the pre-tokenizers' \s (Unicode White_Space).
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DROPPED = re.compile(r"[^ \t\n\r]+").findall
SPACE_IN = re.compile(f"[{SPACES}]").search
RUNS = re.compile(f"([{SPACES}]{{2,}})").split
#: Single white space, with the word after it where that is a blank's.
PARTS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]").findall
#: Letters that no normalizer composes with what stands before them, with plain lower cases.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Signs at a word's end that are pre-tokens of their own; the apostrophe, which starts contractions, is none.
SIGNS = ".,;:!?#%$&*|()[]{}<>/=+@_-\""
PLAIN_ENDS = frozenset(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Chunk to packed ids. What is full becomes the older generation, and the one before it goes; what is found there moves up."""

    def __init__(self, make: Callable[[str], tuple[bytes, bool]], times: int = 1):
        super().__init__()
        self.make, self.times, self.older = make, times, {}

    def __missing__(self, chunk: str) -> bytes:
        if (packed := self.older.get(chunk)) is None:
            packed, keep = self.make(chunk)
            if not keep or len(chunk) > LONGEST:
                return packed
        if len(self) >= self.times * GENERATION:
            self.older = dict(self)
            self.clear()
        self[chunk] = packed
        return packed


class Chunks:
    """The encoder of one vocabulary: chunks that follow a blank and chunks that don't."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = self.tokenizer.normalizer is None
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.words = self.tokenizer.model.tokenize
        self.bare = Known(lambda chunk: self._made(chunk, "", self.bare))
        self.after_blank = Known(lambda chunk: self._made(chunk, " ", self.after_blank), AFTER_BLANK)
        self.odd = False  # whether white space stood beside white space in the text that is being encoded
        self.line_end = self._encoded("\n") if self.kept else b""

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _made(self, chunk: str, lead: str, known: Known) -> tuple[bytes, bool]:
        """The ids of a chunk and its lead, and whether to keep them."""
        if chunk.isalpha() and (chunk.isascii() or PLAIN(chunk)):
            letters = chunk if self.kept else chunk.lower()
            if not chunk.isascii():
                letters = letters.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.words(self.blank + letters if lead else letters)]).tobytes(), True
        base = chunk.rstrip(SIGNS)
        if base != chunk and base and base[-1] in PLAIN_ENDS and (base.isalnum() or not SPACE_IN(base)):
            often = base in known  # a rare word with a sign isn't kept
            return known[base] + self.bare[chunk[len(base) :]], often
        if chunk and not SPACE_IN(chunk):
            return self._encoded(lead + chunk), True
        if not self.kept:
            parts = DROPPED(chunk)
            return (self._encoded(chunk) if parts == [chunk] else b"".join([self.bare[c] for c in parts])), not chunk
        self.odd = True
        return self._spaced(lead + chunk), False

    def _spaced(self, text: str) -> bytes:
        """A text in which no white space stands beside white space."""
        return b"".join([self.after_blank[c[1:]] if c[0] == " " and len(c) > 1 else self.bare[c] if not SPACE_IN(c) else self._encoded(c) for c in PARTS(text)])

    def _lines(self, text: str) -> bytes:
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.bare[first] if first else self._start())
            out += map(self.after_blank.__getitem__, rest)
            out.append(self.line_end)
        return b"".join(out[:-1])

    def _start(self) -> bytes:
        self.odd = True
        return b""

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        for mark in self.marks:
            if mark in text:
                return self._encoded(text)
        if not self.kept:
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        self.odd = False
        packed = self._lines(text)
        return self._with_runs(text) if self.odd else packed

    def _with_runs(self, text: str) -> bytes:
        """A run of white space is one pre-token without its last character, which is the next word's if it is a blank."""
        parts, out, blank = RUNS(text), [], ""
        for i, part in enumerate(parts):
            if i % 2 == 0:
                out.append(self._spaced(blank + part))
                blank = ""
            elif i == len(parts) - 2 and not parts[-1]:
                out.append(self._encoded(part))
            else:
                out.append(self._encoded(part[:-1]))
                blank = part[-1] if part[-1] == " " else ""
                if not blank:
                    out.append(self._encoded(part[-1]))
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> Chunks:
    """The worker's encoder for a vocabulary file."""
    return Chunks(path)
