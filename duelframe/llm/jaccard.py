"""N-gram Jaccard self-join by MinHash banding with exact verification.

1. Shingles of five words are hashed; texts with equal shingle sets form one text class
   and only its representative goes on, so copies are never paired with each other.
2. A signature of ``TREES`` times ``DEPTH`` minimum hashes is a label in each tree of the
   forest. All labels are cut to one depth, fixed beforehand by the target recall; at the
   constants below that is the full depth, so a tree is a band and a node a bucket.
3. Representatives under one trie node are compared by signature, in blocks, and only a
   spanning forest of the likely pairs leaves the task. Its components are small clusters
   that hold all links.
4. Within a cluster all pairs are verified exactly on their shingle sets, again in blocks.
   Tasks give back counts per text and a spanning forest of the links, never pairs.

Nodes and clusters of any size are dealt out as pairs of blocks, so no task holds more than
two blocks and none of their members is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.layout import c
from duelframe.llm.components import components
from duelframe.llm.texts import boxed, runs, small_batches, unboxed, whole
from duelframe.session import materialised

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 6
RECALL = 0.9999
#: Signature values that are carried along for comparison, and how far below the threshold a pair may seem.
SKETCH, MARGIN = 128, 0.18
#: Members of a node that a block compares; shingles and texts of a cluster that a block verifies.
NODE_BLOCK, CLUSTER_BLOCK, CLUSTER_TEXTS = 1_024, 500_000, 256
_REMEMBERED = 100_000
_STEP = 512  # shingles whose hashes are computed at once

_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)], np.uint64)
_words: dict[bytes, int] = {}


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The deepest prefix at which a pair at the threshold is found with probability ``recall``; 1 at least."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _word(w: bytes) -> int:
    found = _words.get(w)
    if found is None:
        if len(_words) >= _REMEMBERED:
            _words.clear()
        found = _words[w] = xxhash.xxh64_intdigest(w)
    return found


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words; of all words together if there are fewer, none without a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += h[i : i + n] * _POWERS[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum hashes folded to 16 bits, tree after tree."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _STEP):
        np.minimum(least, (x[at : at + _STEP, None] * _A + _B).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype("<u2")


def _signed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    row = TaskContext.get().partitionId() << 33
    for pdf in rows:
        out = []
        for k, text in zip(pdf["_k"], pdf["_text"]):
            s = shingles(text)
            digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            out.append((row, k, len(s), digest, signature(s).tobytes() if len(s) else None))
            row += 1
        yield pd.DataFrame(out, columns=["row", "_k", "n", "digest", "sig"])


def _spanning(near) -> list[tuple[int, int]]:
    """Edges from the first member of each component to its others: ``near(i, others)`` says which are adjacent to i.

    With members in order, nodes of different trees give the same edges for the same component.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(near.size)
    while len(left):
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            edges += [(first, j) for j in left[hit].tolist()]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


class _Alike:
    """Likely pairs of a block, by the share of equal signature values."""

    def __init__(self, sketches: np.ndarray, side: np.ndarray | None):
        self.sketches, self.side, self.size = sketches, side, len(sketches)
        self.least = (THRESHOLD - MARGIN) * sketches.shape[1]

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        hit = (self.sketches[others] == self.sketches[i]).sum(axis=1) >= self.least
        return hit if self.side is None else hit & (self.side[others] != self.side[i])


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = [], []
    for g in runs(batches, ["node", "i", "j"]):
        order = np.argsort(g["v"])
        v, block = g["v"][order], g["block"][order]
        sketches = np.frombuffer(b"".join(g["sketch"][order]), "<u2").reshape(len(v), SKETCH)
        for x, y in _spanning(_Alike(sketches, None if g["i"][0] == g["j"][0] else block)):
            a.append(v[x])
            b.append(v[y])
        if len(a) >= 10_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _block_pairs(blocks: Column, block: Column) -> Column:
    """One row for every pair of blocks that a member of ``block`` takes part in."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j"))))


def _dealt(members: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Members with ``block``, ``i``, ``j``, brought together and sorted by (key, i, j)."""
    df = members.withColumn("_blocks", F.greatest(blocks.cast("int"), F.lit(1)))
    df = df.withColumn("block", F.pmod(F.xxhash64("v", F.lit(7)), F.col("_blocks")).cast("int"))
    df = df.withColumn("_p", _block_pairs(F.col("_blocks"), F.col("block"))).select("*", "_p.i", "_p.j").drop("_p", "_blocks")
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact links of a block: per text the linked texts and rows, then the edges of a spanning forest."""
    for g in runs(batches, ["cluster", "i", "j"]):
        _, first = np.unique(g["v"], return_index=True)
        v, copies, block = g["v"][first], g["copies"][first].astype(np.int64), g["block"][first]
        sets = [np.frombuffer(g["shingles"][i], "<u8") for i in first]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(len(values), np.int64)
        within = g["i"][0] == g["j"][0]
        texts, rows = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        label = np.arange(len(v))
        for x in range(len(v)):
            own = place[starts[x] : starts[x] + sizes[x]]
            marked[own] = 1
            shared = np.add.reduceat(marked[place], starts)
            marked[own] = 0
            near = 5 * shared >= 4 * (sizes + sizes[x] - shared)
            near[x] = False
            if not within:
                near &= block != block[x]
            texts[x], rows[x] = near.sum(), copies[near].sum()
            for y in np.unique(label[near]).tolist():
                label[label == max(y, label[x])] = min(y, label[x])
        edges = [(v[a], v[b]) for a, b in enumerate(label.tolist()) if a != b]
        yield pd.DataFrame({"v": v, "b": None, "texts": texts, "rows": rows}).astype({"b": "Int64"})
        if edges:
            yield pd.DataFrame({"v": [e[0] for e in edges], "b": pd.array([e[1] for e in edges], "Int64"), "texts": 0, "rows": 0})


def _shingled(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        sets = [shingles(t) for t in pdf["_text"]]
        yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.astype("<u8").tobytes() for s in sets]})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its class and how many others it is linked to.

    ``class_id``: least key among all rows reached over links, a link being a Jaccard
    similarity of at least 0.8 between sets of five-word shingles; ``text_id``: least key
    among rows with the same set; ``n_copies``: rows with that set, this one included;
    ``n_links``: other rows linked to this one; ``n_text_links``: other sets linked to its set.

    A text of one to four words is one shingle. A null text, or one without words, has no
    shingle and no link, and is a class of its own under its own key. Repeated rows are
    copies of each other; null keys rank last; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, key, text)


def _near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Everything that runs Python is written inside; what is returned only joins the tables."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(c(key).alias("_k"), whole(text).alias("_text"))
    signed = materialised(texts.mapInPandas(_signed, f"row long, _k {kind}, n long, digest binary, sig binary"))
    classes = materialised(
        signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("_k").alias("_text_id"))
    )
    signatures = signed.select(F.col("row").alias("v"), "_k", "n", "digest", "sig")
    reps = materialised(classes.select("v", "copies").join(signatures, "v"))

    # Trie nodes: the label of a tree cut to the depth that gives the target recall.
    depth = prefix_depth()
    label = [F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * depth)) for t in range(TREES)]
    under = reps.select("v", F.explode(F.array(*label)).alias("node"))
    shared = under.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    carried = reps.select("v", F.substring("sig", 1, 2 * SKETCH).alias("sketch"))
    likely = _dealt(under.join(shared, "node").join(carried, "v"), "node", F.ceil(F.col("size") / NODE_BLOCK)).mapInPandas(_likely, "a long, b long")
    clusters = components(likely)

    sized = materialised(clusters.withColumnRenamed("root", "cluster").join(reps.select("v", "copies", "n", "_k", "digest"), "v"))
    size = F.greatest(F.sum("n") / CLUSTER_BLOCK, F.count(F.lit(1)) / CLUSTER_TEXTS)
    volume = sized.groupBy("cluster").agg(F.ceil(size).alias("blocks"))
    wanted = sized.select("_k").distinct()
    sets = texts.join(wanted, texts["_k"].eqNullSafe(wanted["_k"]), "left_semi").mapInPandas(_shingled, "digest binary, shingles binary")
    loaded = sized.select("v", "cluster", "copies", "digest").join(volume, "cluster").join(sets, "digest")
    dealt = _dealt(loaded.select("v", "cluster", "copies", "blocks", "shingles"), "cluster", F.col("blocks"))
    checked = materialised(dealt.mapInPandas(_verified, "v long, b long, texts long, rows long"))
    joined = components(checked.where("b is not null").select(F.col("v").alias("a"), "b"))
    links = checked.where("b is null").groupBy("v").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))

    found = classes.join(links, "v", "left").join(joined, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = found.groupBy("root").agg(F.min("_text_id").alias("_class"))
    found = found.join(least, "root").select("digest", "copies", "texts", "rows", "_text_id", "_class")
    rows = signed.select("_k", "digest").join(found, "digest", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        F.col("_k").alias(key),
        F.coalesce("_class", "_k").alias("class_id"),
        F.coalesce("_text_id", "_k").alias("text_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.coalesce("rows", zero) + F.coalesce("copies", F.lit(1).cast("long")) - 1).alias("n_links"),
        F.coalesce("texts", zero).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class of near duplicates, all columns kept: the one with the least key, null keys last.

    Of equal keys the text with the least hash stays, of equal rows one. Classes that share a key keep
    a row each. Rows without a word are classes of their own and stay. An empty table gives an empty result.
    """
    t = whole(text)
    identity = F.xxhash64(c(key).cast("string"), c(key).isNull(), F.sha2(t, 256))
    rows = docs.select(boxed(docs), identity.alias("_id"), t.alias("_text"))
    # Rows of equal key and text are of one class, so the least of these names no other class.
    named = docs.select(F.struct(c(key).isNull().alias("last"), c(key).alias("key"), identity.alias("id")).alias("_name"), t.alias("_text"))
    first = near_duplicates(named, "_name", "_text").where("_name = class_id").select(F.col("_name.id").alias("_id")).distinct()
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_id"))
    stay = rows.join(first, "_id", "left_semi").withColumn("_place", place).where((F.col("_place") == 1) | ~F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return unboxed(stay, docs.columns)
