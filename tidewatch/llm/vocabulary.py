"""A byte-level BPE vocabulary file as the token operators use it on a worker."""

from __future__ import annotations

import functools
import json
import re

# The vocabulary's pre-token pattern with its classes spelled out for characters
# below U+0250, whose classes no Unicode version has changed (fixed values).
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\\t-\\r \u0085\u00a0"
_FIND = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_BEYOND = re.compile("[^\\x00-\u024f]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in such a vocabulary:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Vocabulary:
    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of a pair, by left id * 2**20 + right id, and the id it merges to, by rank
        self.ranks = {(self.ids[a] << 20) | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.characters = byte_characters()
        to_byte = {c: b for b, c in self.characters.items()}
        self.byte_ids = [self.ids[self.characters[b]] for b in range(256)]
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        strings = [b""] * size
        for s, i in self.ids.items():
            strings[i] = bytes(to_byte[c] for c in s)
        for s, i in self.specials.items():
            strings[i] = s.encode()
        lengths = np.array([len(s) for s in strings], np.int64)
        #: all strings in one array of bytes, with the start and length of each
        self.flat_strings = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def pre_tokens(self, text: str) -> list[str]:
        """As the vocabulary's pre-tokenizer cuts the text, which does it itself
        where the text has characters from U+0250."""
        if not text.isascii() and _BEYOND(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _FIND(text)

    def spelled(self, pre_token: str) -> str:
        """In the vocabulary's own characters."""
        return pre_token.encode().decode("latin-1").translate(self.characters)

    def segments(self, text: str) -> list[str]:
        """The text cut around special strings, which stay as segments of their own."""
        if self.special_split and any(s in text for s in self.specials):
            return [s for s in self.special_split.split(text) if s]
        return [text]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker process."""
    return Vocabulary(path)


class TwoGenerations(dict):
    """A cache of bounded size: when it is full the current generation becomes
    the old one and what was in use moves on, so frequent keys stay. What is in
    `fixed` is taken from there and not computed."""

    def __init__(self, compute, limit: int, fixed: dict | None = None):
        super().__init__()
        self.compute, self.limit, self.old, self.fixed = compute, limit, {}, fixed or {}

    def __missing__(self, key):
        value = self.fixed.get(key)
        if value is None:
            value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
