"""Token ids of whole texts, by a tokenizer file."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from operator import attrgetter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

# Spark gives each task one core
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
assert sys.byteorder == "little" and array("I").itemsize == 4

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: A blank between two visible characters: the byte-level pre-tokenizer always starts a piece there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_CACHED = 400_000  # pieces of text whose ids a worker keeps in each of two generations
_id = attrgetter("id")


def _class(kind: str) -> str:
    """Letters, digits or other visible characters, as a character class: those that have been so since Unicode 3.2."""
    def kinds(char: str) -> set[str]:
        return {k if (k := book.category(char)[0]) in "LNCZ" else "M" for book in (unicodedata, unicodedata.ucd_3_2_0)}

    found = [c for c in range(0x10000) if kinds(chr(c)) == {kind}]
    starts = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


#: The pieces of the byte-level pre-tokenizer, over these characters and plain white space; of other texts some of it is left out.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[{M}]+|[ \t-\r]+(?![{L}{N}{M}])|[ \t-\r]+".format(**{k: _class(k) for k in "LNM"}))


def _visible() -> list[str]:
    """The character by which the byte-level alphabet writes each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_BYTE = _visible()


class _Ids(dict):
    """Ids, as bytes, of what was met; found by ``make`` at first, kept until as many others were asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _CACHED:
            self.before = dict(self)
            self.clear()
        found = self[key] = self.before.get(key) or self.make(key)
        return found


class _Encoder:
    """A tokenizer with the ids of the pieces and words that this worker has met."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        cut = spec["pre_tokenizer"] or {}
        # pieces can be told without the tokenizer if it cuts at the usual ones and changes nothing before that
        self.plain = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
            and not (spec["normalizer"] or spec["truncation"] or spec["padding"])
        )
        self.pieces = _Ids(self.piece)
        self.words = _Ids(lambda word: self.whole(" " + word))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        shown = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalnum() else "".join([_BYTE[b] for b in piece.encode()])
        return array("I", map(_id, self.model.tokenize(shown))).tobytes()

    def ids(self, text: str) -> bytes:
        if self.plain and not any(s in text for s in self.special):
            pieces = _PIECE.findall(text)
            if sum(map(len, pieces)) == len(text):
                return b"".join(map(self.pieces.__getitem__, pieces))
        head, *words = _CUT.split(text)
        return self.whole(head) + b"".join(map(self.words.__getitem__, words))


_loaded: dict[str, _Encoder] = {}


def encode(texts: list[str | None], path: str = DEFAULT) -> list[np.ndarray]:
    """Ids of each text, as of ``encode(text, add_special_tokens=False)``; null counts as empty.

    Texts are cut into the pieces of the byte-level pre-tokenizer, and the tokenizer's
    model gets each different piece once per worker. A text with rarer characters or
    special strings is cut at single blanks, which such a tokenizer never joins, and
    its words go to the whole tokenizer.
    """
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    known = _loaded[path]
    return [np.frombuffer(known.ids(text or ""), "<u4") for text in texts]
