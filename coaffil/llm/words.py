"""Splitting texts into the words of the public tokenizers, inside tasks.

Texts whose characters all lie in ranges where letters, numbers and white space are settled and
NFC changes nothing are split by one compiled pattern; any other text goes to the tokenizers
library's own splitter.  Either way the words are those of the library.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from os.path import commonprefix

import numpy as np
from tokenizers import Tokenizer

#: Characters of the quick way: Latin letters up to U+017F (but U+0130, whose lower case is two characters),
#: general punctuation, the euro sign.  Their lower-case forms are among them.
_QUICK = [*range(0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _QUICK if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_SLOW = re.compile("[^" + "".join(re.escape(chr(c)) for c in _QUICK) + "]")
_BYTE_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_WHITE}{_L}{_N}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_WHITE}{_L}{_N}]+")


def _byte_alphabet() -> dict[int, int]:
    """Byte to character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Splits for byte-level vocabularies (``spaced``: words keep their leading space) or lower-casing ones."""

    def __init__(self, tokenizer: Tokenizer, spaced: bool):
        self.tokenizer, self.spaced = tokenizer, spaced
        added = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.hint = commonprefix([*self.special])  # a text without it holds no special token

        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens' strings stand for themselves."""
        if self.marks and self.hint in text and self.marks.search(text):
            found: list[str] = []
            for part in self.marks.split(text):
                found += [part] if part in self.special else self._plain(part)
            return found
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and _SLOW.search(text):
            t = self.tokenizer
            if t.normalizer is not None:
                text = t.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]
        return _BYTE_WORDS.findall(text) if self.spaced else _PLAIN_WORDS.findall(text.lower())

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids by itself, as little-endian 32-bit integers."""
        plain = [w for w in words if w not in self.special]
        ids = dict(zip(plain, self._encode_plain(plain)))
        return [ids[w] if w in ids else np.array([self.special[w]], "<u4").tobytes() for w in words]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        if self.spaced:
            model = self.tokenizer.model
            return [np.array([t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_ALPHABET))], "<u4").tobytes() for w in words]
        # One call for all: words are set apart by spaces, and a word's last id ends in the end-of-word mark.
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


class IdLookup:
    """Ids of whole texts; each word is encoded once while the table of at most ``most`` words lasts."""

    def __init__(self, path: str, spaced: bool, most: int = 1 << 19):
        self.splitter, self.most = Splitter(load(path), spaced), most
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        words, known = self.splitter.words(text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            new = [w for w in {*words} if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list({*words})
        known.update(zip(new, self.splitter.encode(new)))
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def id_lookup(path: str, spaced: bool) -> IdLookup:
    """The Python worker's own table, kept from task to task."""
    return IdLookup(path, spaced)
