"""Token counts with a whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each on its own. Offline, every vocabulary
string is put through the tokenizer once: those that come back as a single token are proven whole,
and a pre-token equal to one of them counts 1 without a merge. Only the rest is merged, each
distinct pre-token once per task as long as the task's table has room.

The splitting is proven equal to the tokenizer's by trying each code point of the ranges below (a
test does so); a text with a character beyond them goes through the tokenizer whole. Texts are
split at special strings first, as the tokenizer does.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows get equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import map_texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters for which the splitting is not proven (newer letters, whose class depends on Unicode's version).
UNPROVEN = regex.compile(r"[^\x00-\u0557\u1e00-\u208e\u20a0-\ua7cd]")
#: Distinct merged pre-tokens that a task remembers before it starts anew.
REMEMBERED = 1 << 19


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counts:
    """Counts of one byte-level BPE file for the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = regex.compile(_pattern())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.specials else None
        plain = {"lstrip": False, "rstrip": False, "single_word": False, "normalized": False}
        pre = spec["pre_tokenizer"] or {}
        self.usable = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                       and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
                       and all(t.get(k) == v for t in spec["added_tokens"] for k, v in plain.items()))
        self.whole = self._prove() if self.usable else frozenset()
        self.known = dict.fromkeys(self.whole, 1)

    def _prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        byte_of = {c: b for b, c in _byte_characters().items()}
        strings = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                s = bytes(byte_of[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split.fullmatch(s) and not (self.special and self.special.search(s)):
                strings.append(s)
        coded = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, coded) if len(e.ids) == 1)

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """Pre-tokens and special strings of a text, or None if the splitting is not proven for it."""
        if not self.usable or not (text.isascii() or not UNPROVEN.search(text)):
            return None
        if self.special and any(s in text for s in self.specials):
            return [x for part in self.special.split(text) for x in
                    (self.split.findall(part) if part not in self.specials else [part])]
        return self.split.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self._pieces(t) for t in texts]
        new = {x for own in pieces if own for x in set(own).difference(self.known)}
        if len(self.known) + len(new) > len(self.whole) + REMEMBERED:
            new.update(x for own in pieces if own for x in set(own).difference(self.whole))
            self.known = dict.fromkeys(self.whole, 1)
        new = list(new)
        self.known.update(zip(new, self._library(new)))
        get = self.known.__getitem__
        return [sum(map(get, own)) if own is not None else self._library([t])[0] for t, own in zip(texts, pieces)]


def _pattern() -> str:
    """How byte-level BPE splits a text: contractions, then runs of letters, digits or others, then blanks."""
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable bytes stand
    for themselves, the others for the next characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_COUNTS: dict[str, Counts] = {}  # by path, kept by a Python worker from task to task


def _counts(path: str) -> Counts:
    if path not in _COUNTS:
        _COUNTS[path] = Counts(path)
    return _COUNTS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. `path` must be readable on every executor."""
    file = path or vocabulary_path()

    def run(texts, counts):
        return [pa.array([len(t or b"") for t in texts], pa.int64()),
                pa.array(counts.count([t.decode() if t else "" for t in texts]), pa.int64())]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = map_texts(rows, "text", run, "n_bytes bigint, n_tokens bigint", lambda: _counts(file))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
