"""Language-model scoring with a weighted backoff automaton.

N-grams are the arcs of an automaton whose states are contexts; a state without an arc for
a token follows its failure arc to the shorter context and pays the backoff weight.

Every n-gram that occurs at least ``FLOOR`` times is an arc, whatever the size of the corpus.
No worker sees the automaton whole. Texts lie in buckets of a fixed size, and a bucket needs
only the part of the automaton that its own texts can reach. It learns that part in three
rounds, each a shuffle by hash of what it asks and one of the answers:

1. the counts of its distinct tokens and bigrams;
2. the counts of its trigrams whose two bigrams both reach the floor, as no other can;
3. what the arcs of the contexts it fails from add up to, hence their backoff weights.

Then it builds its states, arcs and failure arcs, and walks its texts once. The arc that a position
takes follows from the answers, and with it the state it leads to, so all positions are walked
at once; what a text pays is added up from left to right. Texts stay where they are: buckets and answers are stored as tables
bucketed alike, so that joining them moves nothing.

Probabilities are smoothed by absolute discounting and sum to one over the V known tokens
and one unknown token in every state.
"""

from __future__ import annotations

import gc
import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.layout import c
from duelframe.llm.texts import runs, small_batches, whole
from duelframe.session import materialised, remove_folder, shared_folder

DISCOUNT = 0.6
#: Least count of an n-gram, the same at every size; bytes of texts in a bucket; tokens for which one shard answers (it
#: holds at most two n-grams of each at a time); rows of cells, and bytes of them, that a worker is handed at once.
FLOOR = 2
BUCKET, SHARD, CELLS, AT_ONCE = 3 << 20, 2_000_000, 16, 4 << 20
#: The end of a text, which is also the context of its first word. No word contains white space.
END = b"\n"

_ROW = 33


def tokens(text: str) -> list[bytes]:
    """Words with ASCII letters lower-cased, then the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def unigram(n, total: int, types: int):
    """Smoothed probability of a token that occurs ``n`` times among ``total`` of ``types`` kinds."""
    if not total:
        return 1.0
    return max(n - DISCOUNT, 0.0) / total + DISCOUNT * types / total / (types + 1)


def base(n, total: int, types: int):
    return (n + 1) / (total + 1 * (types + 1))


# --------------------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """States, arcs and failure arcs over token ids below ``width``. State 0 is the root, which has an arc for every token."""

    width: int
    keys: np.ndarray  # of an arc: state * width + token
    weight: array[float]  # of an arc: log10 probability
    target: array[int]  # of an arc: next state
    root: array[float]  # of a token: log10 probability at the root
    enter: array[int]  # of a token: next state from the root
    backoff: array[float]  # of a state: log10 weight of its failure arc
    fail: array[int]  # of a state: where its failure arc leads

    @cached_property
    def arcs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), range(len(self.keys))))

    def walk(self, ids: list[int], state: int) -> float:
        """log10 probability of a token sequence from ``state`` on, in one traversal that looks every arc up."""
        arc, width = self.arcs.get, self.width
        weight, target, root, enter, backoff, fail = self.weight, self.target, self.root, self.enter, self.backoff, self.fail
        score = 0.0
        for w in ids:
            while state:
                a = arc(state * width + w)
                if a is not None:
                    score += weight[a]
                    state = target[a]
                    break
                score += backoff[state]
                state = fail[state]
            else:
                score += root[w]
                state = enter[w]
        return score

    def follow(self, ids: np.ndarray, after_two: np.ndarray, after_one: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
        """What each token of some texts pays on that traversal: at most two failure arcs, then an arc; ``start`` is the state before each text.

        The arcs of each token are at hand: from the state of the two tokens before it, and from that of the one; -1
        is none. An arc that is there is taken: the states before it, which have it, were not left out. So all
        positions know the arc they take, and with it the state after them.
        """
        weight, target, root, enter, backoff, fail = map(np.asarray, (self.weight, self.target, self.root, self.enter, self.backoff, self.fail))
        arc = np.where(after_two >= 0, after_two, after_one)
        found = arc >= 0
        after = enter[ids]
        after[found] = target[arc[found]]
        state = np.concatenate(([start], after[:-1]))
        state[starts] = start
        paid = np.zeros((len(ids), 3))
        paid[:, 2] = root[ids]
        paid[found, 2] = weight[arc[found]]
        missed = np.flatnonzero((state > self.width) & (after_two < 0))
        paid[missed, 0] = backoff[state[missed]]
        state[missed] = fail[state[missed]]
        missed = np.flatnonzero((state > 0) & ~found)
        paid[missed, 1] = backoff[state[missed]]
        return paid


# --------------------------------------------------------------------------- cells of numbers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _of_order(x: np.ndarray, order: int) -> np.ndarray:
    return x & ~np.uint64(3) | np.uint64(order)


def _hashes(words: list[bytes]) -> np.ndarray:
    return _of_order(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), 1)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, so that like bytes lie together and compress; as many bytes as the largest takes, which come first."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(cell: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(cell, np.uint8, offset=1).reshape(cell[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : cell[0]] = planes.T
    return out.view(kind).reshape(-1)


def _rising(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _risen(cell: bytes) -> np.ndarray:
    return np.cumsum(_values(cell, np.uint64), dtype=np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which of them each value is."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()).bit_length() + bits <= 64:
        # A value and its place in one number: sorting those is faster than looking for an order.
        both = values.astype(np.uint64) << np.uint64(bits) | np.arange(len(values), dtype=np.uint64)
        both.sort()
        order, ordered = (both & np.uint64((1 << bits) - 1)).astype(np.int64), (both >> np.uint64(bits)).astype(values.dtype)
    else:
        order = np.argsort(values)
        ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _cuts(keys: np.ndarray, shards: int) -> list[int]:
    """Where each shard begins in sorted keys, and the end."""
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1).astype(np.uint64)).tolist()


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(x, out=np.zeros(len(x)), where=x > 0)


def _array(x: np.ndarray) -> array:
    return array("d" if x.dtype.kind == "f" else "q", x.tobytes())


def _questions(bucket: int, keys: np.ndarray, times: np.ndarray, shards: int) -> pd.DataFrame:
    """A row for each shard that is asked for some of the ``keys``, which occur ``times`` times in training texts here."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    cuts = _cuts(keys, shards)
    out = [(s, bucket, _rising(keys[i:j]), _planes(times[i:j])) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    return pd.DataFrame(out, columns=["shard", "bucket", "x", "y"])


def _answers(keys: np.ndarray, told: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """For each key its count, and whether this bucket accounts for it."""
    out = np.zeros(len(keys), np.int64)
    if len(keys):
        out[np.argsort(keys)] = np.concatenate([_values(cell) for cell in told])
    return out >> 1, out & 1 == 1


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers of a shard: counts over all buckets, twice, plus one in a single bucket for each n-gram.

    ``types`` adds up to the number of different tokens in training texts.
    """
    for g in runs(batches, ["shard"]):
        # A shard is the most that a task holds: its numbers are put in order once, and go as soon as they have been used.
        keys = [_risen(k) for k in g["x"]]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        types = np.zeros(len(keys), np.int64)
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        token = keys[starts] & np.uint64(3) == 1
        del keys
        times = np.concatenate([_values(t) for t in g["y"]])[order]
        n = np.add.reduceat(times, starts)
        types[0] = np.count_nonzero(token & (n > 0))
        del times
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(n * 2, np.diff(starts, append=len(order)))
        out[order[starts]] += 1
        del order, starts, n, token
        told = pd.DataFrame({"bucket": g["bucket"], "shard": g["shard"], "x": [_planes(cell) for cell in np.split(out, ends)], "types": types})
        # Nothing of this shard stays while the next one is read.
        del g, out
        yield told
        del told


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers of a shard of contexts: three sums over the arcs of each context that a bucket wants, zeros without arcs."""
    for g in runs(batches, ["shard"]):
        keys, _, which = _distinct(np.concatenate([_risen(k) for k in g["x"]]))
        parts = np.concatenate([_values(v).reshape(3, -1) for v in g["y"]], axis=1)
        sums = np.zeros((3, len(keys) + 1), np.int64)
        for row, part in zip(sums, parts):
            row[: len(keys)] = np.bincount(which, part, len(keys))
        buckets, cells = [], []
        for b, cell in zip(g["bucket"].tolist(), g["wanted"]):
            wanted = _risen(cell)
            if not len(wanted):
                continue
            at = np.searchsorted(keys, wanted)
            if len(keys):
                at[keys[np.minimum(at, len(keys) - 1)] != wanted] = len(keys)
            buckets.append(b)
            cells.append(_planes(sums[:, at].reshape(-1)))
        told = pd.DataFrame({"bucket": buckets, "shard": g["shard"][0], "x": cells, "types": 0})
        del g, keys, which, parts, sums, cells
        yield told
        del told


# --------------------------------------------------------------------------- buckets


class _Bucket:
    """The positions of some texts, one for each token, and the distinct n-grams that end there.

    Tokens have local ids, in order of their hashes. A pair is a bigram, a triple a trigram; the
    end of a text is what comes before the next one, and no triple crosses it.
    """

    def __init__(self, vocabulary: bytes, ids: bytes, lengths: np.ndarray, trained: np.ndarray):
        self.h = _risen(vocabulary)
        self.ids = np.ascontiguousarray(np.frombuffer(zlib.decompress(ids), np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1).astype(np.int64)
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.end = int(np.searchsorted(self.h, _hashes([END])[0]))
        self.width = len(self.h)
        self.before = np.concatenate(([self.end], self.ids[:-1]))
        pairs, _, self.pair = _distinct(self.before * self.width + self.ids)
        self.first, self.second = np.divmod(pairs, self.width)
        self.h2 = _of_order(_mixed(self.h[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.h[self.second]), 2)
        self.times = np.repeat(np.asarray(trained, bool), self.lengths).astype(np.float64)

    def find_triples(self) -> None:
        deep = np.ones(len(self.ids), bool)
        deep[self.starts] = False
        self.deep = np.flatnonzero(deep)  # positions with two tokens before them
        found, place, self.triple = _distinct(self.pair[self.deep - 1] * self.width + self.ids[self.deep])
        self.context, self.last = np.divmod(found, self.width)
        self.lower = self.pair[self.deep[place]]  # the pair that a triple ends in
        self.open = np.flatnonzero((self.n2[self.context] >= FLOOR) & (self.n2[self.lower] >= FLOOR))
        self.h3 = _of_order(_mixed(self.h2[self.context[self.open]] * np.uint64(0xC2B2AE3D27D4EB4F) + self.h[self.last[self.open]]), 3)  # of the open ones

    def ask_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        one = np.bincount(self.ids, self.times, self.width)
        two = np.bincount(self.pair, self.times, len(self.h2))
        return np.concatenate((self.h, self.h2)), np.concatenate((one, two)).astype(np.int64)

    def hear_pairs(self, told: list[bytes]) -> None:
        n, mine = _answers(np.concatenate((self.h, self.h2)), told)
        self.n1, self.n2, self.mine2 = n[: self.width], n[self.width :], mine[self.width :]

    def ask_triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Triples whose two pairs reach the floor; no other can."""
        self.find_triples()
        times = np.bincount(self.triple, self.times[self.deep], len(self.last))
        return self.h3, times[self.open].astype(np.int64)

    def hear_triples(self, told: list[bytes] | None) -> None:
        self.n3, self.mine3 = np.zeros(len(self.last), np.int64), np.zeros(len(self.last), bool)
        self.n3[self.open], self.mine3[self.open] = _answers(self.h3, told)

    def find_failures(self) -> None:
        """Contexts that some position fails from: pairs, then tokens. Those below the floor are no states."""
        missed = np.ones(len(self.ids), bool)
        missed[self.deep] = self.n3[self.triple] < FLOOR
        from_pair = self.pair[self.deep - 1][missed[self.deep]]
        from_token = self.before[missed & (self.n2[self.pair] < FLOOR)]
        two, one = (np.flatnonzero(np.bincount(x, minlength=len(n)) * (n >= FLOOR)) for x, n in ((from_pair, self.n2), (from_token, self.n1)))
        self.failing, self.wanted = (two, one), np.concatenate((self.h2[two], self.h[one]))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of the arcs this bucket accounts for, sorted, with the sums of counts, of lower counts, and the number of arcs."""
        keys, found = [], []
        pairs, triples = np.flatnonzero(self.mine2 & (self.n2 >= FLOOR)), np.flatnonzero(self.mine3 & (self.n3 >= FLOOR))
        for h, context, n, low in (
            (self.h, self.first[pairs], self.n2[pairs], self.n1[self.second[pairs]]),
            (self.h2, self.context[triples], self.n3[triples], self.n2[self.lower[triples]]),
        ):
            arcs = np.bincount(context, minlength=len(h))
            some = np.flatnonzero(arcs)
            keys.append(h[some])
            found.append([np.bincount(context, x, len(h))[some].astype(np.int64) for x in (n, low)] + [arcs[some]])
        key = np.concatenate(keys)
        order = np.argsort(key)
        return key[order], np.concatenate(found, axis=1)[:, order]

    def automaton(self, told: list[bytes] | None, total: int, types: int) -> Automaton:
        """The part of the automaton that these texts reach. States: the root, a token each, a pair each."""
        two, one = self.failing
        sums = np.zeros((3, len(self.wanted)))
        if len(self.wanted):
            sums[:, np.argsort(self.wanted)] = np.concatenate([_values(x).reshape(3, -1) for x in told], axis=1)
        n, low, arcs = sums
        rest = DISCOUNT * types / total / (types + 1) if total else 0.0
        k = len(two)
        taken = (n - DISCOUNT * arcs) / np.concatenate((self.n2[two], self.n1[one]))
        low -= DISCOUNT * arcs
        low[:k] /= self.n1[self.second[two]]
        low[k:] = low[k:] / max(total, 1) + arcs[k:] * rest
        backoff = np.zeros(1 + self.width + len(self.h2))
        backoff[np.concatenate((1 + self.width + two, 1 + one))] = np.log10(np.maximum(1 - taken, 1e-9) / np.maximum(1 - low, 1e-9))

        n1 = self.n1.astype(np.float64)
        root = np.maximum(n1 - DISCOUNT, 0.0) / total + rest if total else np.ones(self.width)
        enter = np.where(self.n1 >= FLOOR, np.arange(1, self.width + 1), 0)
        pairs, triples = np.flatnonzero(self.n2 >= FLOOR), np.flatnonzero(self.n3 >= FLOOR)
        keys = np.concatenate(((1 + self.first[pairs]) * self.width + self.second[pairs], (1 + self.width + self.context[triples]) * self.width + self.last[triples]))
        # A context without arcs costs nothing to fail from, so whatever leads to it leads on to where it fails to.
        used = backoff != 0
        used[keys // self.width] = True
        used[0] = True
        enter = np.where(used[enter], enter, 0)
        ends = 1 + self.width + np.concatenate((pairs, self.lower[triples]))
        ends = np.where(used[ends], ends, enter[self.second[ends - 1 - self.width]])
        p = np.concatenate(((self.n2[pairs] - DISCOUNT) / n1[self.first[pairs]], (self.n3[triples] - DISCOUNT) / self.n2[self.context[triples]]))
        return Automaton(
            width=self.width,
            keys=keys,
            weight=_array(_log10(p)),
            target=_array(ends),
            root=_array(_log10(root)),
            enter=_array(enter),
            backoff=_array(backoff),
            fail=_array(np.concatenate((np.zeros(1 + self.width, np.int64), enter[self.second]))),
        )

    def arcs_at(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the arc of its triple and that of its pair, as ``automaton`` numbers them; -1 where there is none."""
        numbers, before = [], 0
        for n in (self.n2, self.n3):
            has = n >= FLOOR
            numbers.append(np.where(has, before + np.cumsum(has) - 1, -1))
            before += np.count_nonzero(has)
        two = np.full(len(self.ids), -1)
        two[self.deep] = numbers[1][self.triple]
        return two, numbers[0][self.pair]

    def scores(self, told: list[bytes] | None, total: int, types: int) -> pd.DataFrame:
        """A row for each text, which is walked once; what it pays is added up from left to right."""
        n1 = self.n1[self.ids]
        plain = np.add.reduceat(np.log10((n1 + 1) / (total + types + 1)), self.starts)
        known = np.add.reduceat((n1 > 0).astype(np.int64), self.starts)
        del n1
        model = self.automaton(told, total, types)
        paid = model.follow(self.ids, *self.arcs_at(), self.starts, model.enter[self.end])
        score = np.bincount(np.repeat(np.arange(len(self.lengths)), 3 * self.lengths), paid.reshape(-1), len(self.lengths))
        return pd.DataFrame({"n": self.lengths, "known": known, "base": plain, "score": score})


def _opened(r: pd.Series) -> _Bucket:
    """The bucket of a row, with the answers that the row holds."""
    m = _Bucket(r["h"], r["ids"], r["lengths"], r["trained"])
    if "pairs" in r:
        m.hear_pairs(r["pairs"])
    if "triples" in r:
        m.find_triples()
        m.hear_triples(r["triples"])
        m.find_failures()
    return m


def _each(work: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` on one row after another; what it holds of a row is gone before the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                yield work(pdf.iloc[i])

    return run


def _in_buckets(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """Tokens of about ``size`` bytes of texts in a row, as local ids, with their keys; texts are whole."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TaskContext.get().partitionId() << _ROW
        keys, trained, lengths, flat, held = [], [], [], [], 0

        def full() -> pd.DataFrame:
            coded = pa.concat_arrays(flat).dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            h = _hashes(words)
            order = np.argsort(h)
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            ids = rank[coded.indices.to_numpy()]
            packed = zlib.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
            own = sum(n for n, t in zip(lengths, trained) if t)
            row = {"bucket": [bucket], "keys": [keys], "trained": [trained], "lengths": [lengths], "h": [_rising(h[order])], "ids": [packed]}
            return pd.DataFrame(row | {"n": [len(ids)], "own": [own]})

        for pdf in batches:
            for k, t, own in zip(pdf["_k"], pdf["_text"], pdf["_train"]):
                words = tokens(t)
                keys.append(k)
                trained.append(bool(own))
                lengths.append(len(words))
                flat.append(pa.array(words, pa.large_binary()))
                held += len(t)
                if held >= size:
                    yield full()
                    bucket += 1
                    keys, trained, lengths, flat, held = [], [], [], [], 0
        if keys:
            yield full()

    return rows.mapInPandas(fill, f"bucket long, keys array<{kind}>, trained array<boolean>, lengths array<long>, h binary, ids binary, n long, own long")


class _Tables:
    """Tables with a row for each bucket, bucketed alike in the shared folder, so that joins of them shuffle nothing.

    Leaving the context drops them and deletes their files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        self.made: dict[str, str] = {}

    def __enter__(self) -> _Tables:
        return self

    def __exit__(self, *_) -> None:
        for name, folder in self.made.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(self.spark, folder)

    def store(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark)
        name = folder.rsplit("/", 1)[1].replace("-", "_")
        self.made[name] = folder
        # Cells have megabytes. Codecs that take a page at once, such as snappy, keep buffers of that size outside the heap; this one streams.
        df.write.bucketBy(self.parts, "bucket").format("parquet").option("compression", "zstd").option("path", folder).saveAsTable(name)
        return self.spark.table(name)

    def by_bucket(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.parts, "bucket")

    def answers(self, df: DataFrame, name: str) -> DataFrame:
        """All answers to a bucket in one row, in order of the shards."""
        cells = F.transform(F.array_sort(F.collect_list(F.struct("shard", "x"))), lambda s: s["x"])
        return self.store(self.by_bucket(df).groupBy("bucket").agg(cells.alias(name), F.sum("types").alias("types_" + name)))


def _swept(spark: SparkSession) -> None:
    """Drop what nothing refers to any more, so that Spark deletes the shuffle files of a round that is written."""
    gc.collect()
    spark._jvm.System.gc()


def backoff_scores(docs: DataFrame, in_train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row, by a model of the
    texts where ``in_train`` holds.

    A null text counts as empty and has one token, the end. Repeated rows are scored one by one; a null key stays
    null; an empty table gives an empty result; with an empty training corpus every token has probability one.
    Extra columns are ignored. Texts are walked whole: a very long one is a bucket of its own, and a task holds one
    bucket and one shard. Buckets and shards are of a fixed size and grow in number.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(c(key).alias("_k"), whole(text).alias("_text"), F.coalesce(in_train, F.lit(False)).alias("_train"))
    with _Tables(spark) as tables, small_batches(spark, CELLS, AT_ONCE):
        with small_batches(spark, 1_000):
            buckets = tables.store(tables.by_bucket(_in_buckets(rows, kind, BUCKET)))
        n_tokens, total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
        shards = max(1, math.ceil(n_tokens / SHARD))
        texts = buckets.select("bucket", "h", "ids", "lengths", "trained")

        def ask_pairs(r: pd.Series) -> pd.DataFrame:
            return _questions(r["bucket"], *_opened(r).ask_pairs(), shards)

        def ask_triples(r: pd.Series) -> pd.DataFrame:
            return _questions(r["bucket"], *_opened(r).ask_triples(), shards)

        def ask_contexts(r: pd.Series) -> pd.DataFrame:
            m = _opened(r)
            (keys, sums), wanted = m.sums(), np.sort(m.wanted)
            a, w = _cuts(keys, shards), _cuts(wanted, shards)
            out = [
                (s, r["bucket"], _rising(keys[i:j]), _planes(sums[:, i:j].reshape(-1)), _rising(wanted[k:l]))
                for s, (i, j, k, l) in enumerate(zip(a, a[1:], w, w[1:]))
                if i < j or k < l
            ]
            return pd.DataFrame(out, columns=["shard", "bucket", "x", "y", "wanted"])

        def walk(r: pd.Series) -> pd.DataFrame:
            return _opened(r).scores(r["contexts"], total, types).assign(_k=list(r["keys"]))

        def by_shard(df: DataFrame) -> DataFrame:
            return df.repartition("shard").sortWithinPartitions("shard")

        asked, told = "shard long, bucket long, x binary, y binary", "bucket long, shard long, x binary, types long"
        pairs = tables.answers(by_shard(texts.mapInPandas(_each(ask_pairs), asked)).mapInPandas(_counted, told), "pairs")
        types = pairs.agg(F.coalesce(F.sum("types_pairs"), F.lit(0))).first()[0]
        _swept(spark)
        texts = texts.join(pairs.drop("types_pairs"), "bucket", "left")
        triples = tables.answers(by_shard(texts.mapInPandas(_each(ask_triples), asked)).mapInPandas(_counted, told), "triples")
        _swept(spark)
        texts = texts.join(triples.drop("types_triples"), "bucket", "left")
        contexts = tables.answers(by_shard(texts.mapInPandas(_each(ask_contexts), asked + ", wanted binary")).mapInPandas(_summed, told), "contexts")
        _swept(spark)
        texts = texts.join(contexts.drop("types_contexts"), "bucket", "left").join(buckets.select("bucket", "keys"), "bucket")
        found = materialised(texts.mapInPandas(_each(walk), f"_k {kind}, n long, known long, base double, score double"))
    return found.select(
        F.col("_k").alias(key),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
