"""Token ids of whole texts by the `tokenizers` library, memoised by word.

Both supported layouts cut a text into pre-tokens before any merge is applied, so
the ids of a text are the concatenated ids of stretches that begin and end at
certain pre-token borders.  `WordCoder` cuts at such borders only, keeps the ids
of up to `max_words` stretches per worker, and asks the library for the others.
Texts whose white space makes a border uncertain are handed to the library whole.
`tests/llm/test_token_ops.py` holds the ids against plain `Tokenizer.encode`.

Special-token strings inside a text are ordinary text (the note beside the
vocabulary files says how).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

_TAIL = ".,;:!?#$%&*|)(\"-"
_PUZZLE = re.compile(r"\s[ \n]|[ \n]\s|^[ \n]|[ \n]$")
_SPACE = re.compile(r"\s")
_ODD = re.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the library


def _byte_alphabet() -> list[str]:
    """Byte -> printable character, the usual byte-level alphabet."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class WordCoder:
    """Ids as little-endian unsigned 32-bit bytes for whole texts.

    `path`: a tokenizer JSON file, byte-level (white space kept) or with word ends
    (lower-cased, white space dropped); the kind is read from the file's
    normalizer.  `max_words` bounds the memo: once full, further words are encoded
    each time they occur, so memory is bounded and results do not change.
    """

    def __init__(self, path: str, max_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.keeps_space = self.tok.normalizer is None
        self.alphabet = _byte_alphabet()
        self.to_printable = dict(enumerate(self.alphabet))
        self.max_words = max_words
        self.led: dict[str, bytes] = {}  # stretches with a space before them
        self.bare: dict[str, bytes] = {}
        self.line = self._library("\n")

    def _library(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _letters(self, stem: str, lead: str) -> bytes:
        """Ids of one pre-token made of letters only."""
        if stem.isascii():
            mapped = self.alphabet[32] + stem if lead else stem
        else:
            mapped = (lead + stem).encode().decode("latin-1").translate(self.to_printable)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(mapped)])

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a stretch without white space, `lead` (a space or nothing) before it."""
        memo = self.led if lead else self.bare
        got = memo.get(word)
        if got is not None:
            return got
        keep = True
        stem = word.rstrip(_TAIL)
        if len(stem) < len(word) and stem.isalpha():
            keep = stem in memo  # a word met for the first time is kept once, without its point
            got = self._word(stem, lead) + self._word(word[len(stem) :], "")
        elif self.keeps_space:
            got = self._letters(word, lead) if word.isalpha() else self._library(lead + word)
        elif word.isascii() and word.isalpha():
            low = word.lower()
            keep = low == word or low in memo
            got = self._letters(low, "") if low == word else self._word(low, lead)
        else:
            got = self._library(lead + word)
        if keep and len(self.led) + len(self.bare) < self.max_words:
            memo[word] = got
        return got

    def _missing(self, piece: str, lead: str) -> bytes:
        if not self.keeps_space:
            return self._library(piece) if _ODD.search(piece) else self._word(piece, "")
        if "\n" not in piece:
            return self._library(lead + piece) if _SPACE.search(piece) else self._word(piece, lead)
        first, *rest = piece.split("\n")
        out = [self._missing(first, lead)]
        for part in rest:
            out += [self.line, self._missing(part, "")]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null and empty give no ids."""
        if not text:
            return b""
        if not self.keeps_space:
            if _ODD.search(text):
                return self._library(text)
            words = text.split()
            out = list(map(self.bare.get, words))
        elif _PUZZLE.search(text):
            return self._library(text)
        else:
            words = text.split(" ")
            out = list(map(self.led.get, words))
            out[0] = self._missing(words[0], "")
        if None in out:
            lead = " " if self.keeps_space else ""
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._missing(words[i], lead)
        return b"".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    """The worker's coder of a vocabulary; it outlives tasks, and so does its memo."""
    return WordCoder(path)
