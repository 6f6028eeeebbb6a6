"""Packing token sequences by non-negative least squares over length combinations.

1. Every text is tokenised once and its ids are written to the shared folder.
2. Full windows are cut off every document. What is left, the remainder, has a length
   below the window; Spark counts remainders by length, a histogram of fixed size.
3. Combinations of two and three lengths that fill a window exactly are enumerated on a
   grid of lengths. Non-negative least squares finds how often to repeat each so that the
   histogram is used up. The result is a recipe of bounded size.
4. Every task applies the recipe to blocks of its own documents: repeat counts are scaled
   to the block and rounded, combinations take the longest remainders of their classes
   (the last one is cut to fit), and what is left over is packed greedily, cutting
   at window ends. The last, open sequence of a block is cut at powers of two, which need
   no padding. So nothing is shuffled and no sequence needs rows of two tasks.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from duelframe.layout import c
from duelframe.llm.texts import small_batches, whole
from duelframe.session import materialised

WINDOW = 2048
END_ID = 1
#: Lengths are grouped into so many classes for the combinations.
CLASSES = 64
#: Tokens that a task packs at once; bounds its memory, and decides nothing but where a block ends.
BLOCK_TOKENS = 4_000_000
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def _encoding(path: str):
    """The byte-level vocabulary as an encoder; one per Python worker."""
    import json

    import public_tokenizers
    import tiktoken

    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    ranks = {bytes(letters[x] for x in token): i for token, i in vocab.items() if token not in SPECIAL}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``ids`` as little-endian unsigned 16-bit integers, ``n``), each document closed by the end id."""

    def encode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoding(path)
        if encoder.n_vocab > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        for pdf in rows:
            ids = [np.append(encoder.encode_to_numpy(t, allowed_special="all"), END_ID).astype("<u2") for t in pdf["_text"]]
            yield pd.DataFrame({"_k": pdf["_k"], "ids": [x.tobytes() for x in ids], "n": [len(x) for x in ids]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(c(key).alias("_k"), whole(text).alias("_text")).mapInPandas(encode, f"_k {kind}, ids binary, n long")


def class_of(lengths: np.ndarray, window: int = WINDOW, classes: int = CLASSES) -> np.ndarray:
    """Class of a remainder of 1 to ``window`` - 1 tokens."""
    return (np.asarray(lengths) - 1) * classes // window


def combinations(classes: int = CLASSES) -> list[tuple[int, ...]]:
    """Pairs and triples of classes whose lengths can add up to the window, in units of the grid."""
    pairs = [(a, classes - 1 - a) for a in range((classes + 1) // 2)]
    triples = [(a, b, classes - 2 - a - b) for a in range(classes) for b in range(a, classes) if b <= classes - 2 - a - b]
    return [tuple(sorted(x, reverse=True)) for x in pairs + triples]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes a @ x closest to b: accelerated projected gradients, deterministic, size fixed by the grid."""
    gram, target = a.T @ a, a.T @ b
    step = 1.0 / max(float(np.linalg.norm(gram, 2)), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (gram @ y - target), 0.0)
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


def recipe(histogram: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Combinations worth repeating, with repeat counts per remainder of the histogram, most frequent first."""
    total = float(histogram.sum())
    if not total:
        return []
    found = combinations(len(histogram))
    a = np.zeros((len(histogram), len(found)))
    for j, combination in enumerate(found):
        for k in combination:
            a[k, j] += 1
    x = nnls(a, histogram / total)
    return sorted(((q, float(v)) for q, v in zip(found, x) if v > 1e-6), key=lambda r: (-r[1], r[0]))


class _Sequences:
    """Pieces of one block, each with its sequence and offset."""

    def __init__(self, window: int):
        self.window, self.pieces, self.count = window, [], 0

    def whole(self, *pieces: tuple[int, int, int]) -> None:
        """One sequence from (document, start, length)s."""
        at = 0
        for doc, start, length in pieces:
            self.pieces.append((doc, start, length, self.count, at))
            at += length
        self.count += 1

    def open_end(self, pieces: list[tuple[int, int, int]]) -> None:
        """The last sequence of a block, cut into powers of two."""
        while pieces:
            left = sum(p[2] for p in pieces)
            size, taken = 1 << (left.bit_length() - 1), []
            while size:
                doc, start, length = pieces.pop(0)
                if length > size:
                    pieces.insert(0, (doc, start + size, length - size))
                    length = size
                taken.append((doc, start, length))
                size -= length
            self.whole(*taken)


def pack_block(lengths: list[int], rules: list[tuple[tuple[int, ...], float]], window: int = WINDOW, classes: int = CLASSES) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a block of documents of these lengths."""
    out = _Sequences(window)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(classes)]
    n = 0
    for doc, length in enumerate(lengths):
        for start in range(0, length - window + 1, window):
            out.whole((doc, start, window))
        if rest := length % window:
            bins[int(class_of(rest, window, classes))].append((doc, length - rest, rest))
            n += 1
    for group in bins:
        group.sort(key=lambda p: (p[2], -p[0]))
    for combination, share in rules:
        for _ in range(round(share * n)):
            need = {k: combination.count(k) for k in combination}
            if any(len(bins[k]) < m for k, m in need.items()):
                break
            chosen = [bins[k].pop() for k in combination]
            room = window - sum(p[2] for p in chosen)
            if room < 0:
                doc, start, length = chosen[-1]
                if length + room <= 0:
                    for k, p in zip(combination, chosen):
                        bins[k].append(p)
                    break
                chosen[-1] = (doc, start, length + room)
                rest = (doc, start + length + room, -room)
                bins[int(class_of(-room, window, classes))].insert(0, rest)
            elif room:
                for k, p in zip(combination, chosen):
                    bins[k].append(p)
                break
            out.whole(*chosen)
    # Residuals: longest first into one open sequence, closed with the piece that fits best, else with a cut one.
    left = sorted((p for group in bins for p in group), key=lambda p: (-p[2], p[0], p[1]))
    heap: list[tuple[int, int, int, int]] = [(-p[2], p[0], p[1], 0) for p in left]
    heapq.heapify(heap)
    current, room = [], window
    while heap:
        size, doc, start, _ = heapq.heappop(heap)
        length = -size
        if length > room:
            heapq.heappush(heap, (-(length - room), doc, start + room, 0))
            length = room
        current.append((doc, start, length))
        room -= length
        if not room:
            out.whole(*current)
            current, room = [], window
    out.open_end(current)
    return out.pieces


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is its end id alone. Repeated rows are documents of their own;
    a null key stays null; an empty table gives no pieces. Sequences hold at most
    ``window`` tokens and are either full or a power of two long, so none needs padding.
    Their ids are unique and stable for a given written table, not consecutive.
    """
    with small_batches(docs.sparkSession):
        table = materialised(tokenised(docs, path, key, text))
    rest = F.col("n") % window
    per_class = table.where(rest > 0).groupBy(F.floor((rest - 1) * CLASSES / window).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(CLASSES)
    for row in per_class.collect():  # at most CLASSES rows
        histogram[row["k"]] = row["n"]
    rules = recipe(histogram)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        keys, ids = [], []

        def packed() -> pd.DataFrame:
            nonlocal first
            pieces = pack_block([len(x) for x in ids], rules, window)
            out = pd.DataFrame(
                [
                    (keys[d], s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), first + q, o)
                    for d, s, n, q, o in pieces
                ],
                columns=["_k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += int(out["sequence_id"].max()) + 1 - first if len(out) else 0
            keys.clear()
            ids.clear()
            return out

        held = 0
        for pdf in rows:
            for k, raw in zip(pdf["_k"], pdf["ids"]):
                keys.append(k)
                ids.append(np.frombuffer(raw, "<u2"))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield packed()
                    held = 0
        if keys:
            yield packed()

    kind = docs.schema[key].dataType.simpleString()
    pieces = table.select("_k", "ids").mapInPandas(
        run, f"_k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("_k", key)
