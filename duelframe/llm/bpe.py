"""BPE encoding and decoding with a contiguous rank array.

A word is an array of parts beside the ranks of the merges of neighbouring parts. The
least rank is found by scanning, its boundary is deleted, and the two ranks beside it are
refreshed. Words are short, so the scan beats any clever queue; a word too long for that
uses a heap over the same ranks, with the same result.

Classes and cases of letters follow Unicode 16 and 17 as the tokenizer does; the order of a few
combining marks of those versions, which Python does not know, may differ.

The vocabulary file is read by path on every executor. Words and white-space-free
stretches of text are remembered per Python worker, in tables of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c
from duelframe.llm.packing import _byte_letters
from duelframe.llm.texts import whole

#: Words with more parts than this use the heap.
SHORT = 128
#: Entries of a worker's tables; they are emptied when full.
REMEMBERED = 200_000
#: Rows handed back at once, which bounds the Arrow batches of long texts.
ROWS = 500

#: White space as the tokenizer's own patterns see it, and its word pattern.
_WHITE = r"\t-\r \x85\xa0  -     　"

#: Letters and digits of Unicode versions after 16, which the tokenizer does not know as such.
_LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 "
)
_NEW = "".join("-".join(rf"\U{x:0>8}" for x in r.split("-")) for r in _LATER.split())
_ANY_NEW = regex.compile(f"[{_NEW}]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
_WORDS_OLD = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_NEW}]]+|[\p{{N}}--[{_NEW}]]|[[^{_WHITE}\p{{L}}\p{{N}}]||[{_NEW}]]+"
)
#: Small letters of capitals that came after Python's Unicode version.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}
_CAPITALS = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")
_STRETCH = regex.compile(rf"[^{_WHITE}]+")
_NO_RANK = 1 << 40


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        if model["type"] != "BPE" or stored["decoder"] is not None or model["end_of_word_suffix"] is None:
            raise ValueError(f"{path} is no BPE vocabulary with word ends and without a decoder")
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        by_byte = {b: letter for letter, b in _byte_letters().items()}
        self.inner = [vocab[by_byte[b]] for b in range(256)]
        self.last = [vocab[by_byte[b] + self.end] for b in range(256)]
        self.ranks: dict[int, int] = {}  # of a pair of neighbouring ids
        self.merged: list[int] = []  # id by rank
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._words: dict[str, bytes] = {}
        self._stretches: dict[str, bytes] = {}

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._scanned(parts) if len(parts) <= SHORT else self._queued(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        ranks = [rank(a << 32 | b, _NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = new = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], _NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, _NO_RANK)
        return parts

    def _queued(self, parts: list[int]) -> list[int]:
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or rank(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(parts[i] << 32 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = array("I", self.word_ids(word)).tobytes()
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            if len(word) <= SHORT:
                self._words[word] = found
        return found

    def _stretch(self, stretch: str) -> bytes:
        words = _WORDS if stretch.isascii() or not _ANY_NEW.search(stretch) else _WORDS_OLD
        found = b"".join(map(self._word, words.findall(stretch)))
        if len(self._stretches) >= REMEMBERED:
            self._stretches.clear()
        if len(stretch) <= SHORT:
            self._stretches[stretch] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Letter by letter: a final sigma is lower-cased like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _CAPITALS.search(text):
                text = text.translate(_SMALL)
        text = text.lower()
        split = text.split() if not regex.search("[\x1c-\x1f]", text) else _STRETCH.findall(text)
        known, fresh = self._stretches.get, self._stretch
        return b"".join([known(s) or fresh(s) for s in split])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without added special tokens; those in the text are kept."""
        if not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens in a row with a space between, special ones included: what a vocabulary without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (binary, little-endian unsigned 32-bit), ``decoded``.

    A null or empty text has no ids and decodes to the empty text. Repeated rows are
    encoded alike, one by one; a null key stays null; an empty table gives an empty result.
    Very long texts are encoded whole; a very long word takes n log n steps.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in rows:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                ids = [bpe.encode_bytes(t) for t in part["_text"]]
                texts = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pd.DataFrame({"_k": part["_k"].to_numpy(), "ids": ids, "decoded": texts})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(c(key).alias("_k"), whole(text).alias("_text"))
    return rows.mapInPandas(run, f"_k {kind}, ids binary, decoded string").withColumnRenamed("_k", key)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
