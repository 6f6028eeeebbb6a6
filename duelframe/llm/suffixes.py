"""Removal of long repeated byte strings by minimum-hash keys and exact comparison.

A suffix-array pass would rank the suffix at every byte, with one sort of all positions per
doubling. Here Spark groups keys once, and only positions that can still be repeated are
ranked, inside their texts:

1. Rank at 100 bytes. Ranks of 1, 2, 4, ... bytes are doubled inside a text up to 100 (a
   rank is a 64-bit hash of the bytes, so equal strings of any two texts have equal ranks).
   Each 200-byte string is keyed by the least 100-byte rank within it. Strings that follow
   each other mostly share that key, so a text becomes one stretch per 50 bytes or so.
   Spark groups the keys; stretches with a unique key hold no repeated string and are dropped.
2. Rank of the stretch. Surviving stretches are ranked by (key, rank of all their bytes).
   If that is not unique, every 200-byte string in the stretch is repeated.
3. Rank at 200 bytes, the threshold. Where a key has stretches of different ranks, one of
   each is opened: its positions are ranked by the pair (rank at p, rank at p + 100).

Equal strings have equal keys, so no repeat is missed, within a text or between texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c
from duelframe.llm.texts import boxed, runs, small_batches, whole
from duelframe.session import materialised

LENGTH = 200
GRAM = LENGTH // 2
_WIDTH = LENGTH - GRAM + 1  # 100-byte strings within a 200-byte one
#: Stretches of one key that a task compares at once; more are dealt out by the rank of their positions.
BLOCK = 512
_PIECE = 1 << 20  # bytes of a text ranked at once
_ROWS = 200_000  # stretches handed back at once
_OUT = 1_000  # texts handed back at once

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranks(data: bytes, length: int = GRAM) -> np.ndarray:
    """Rank of the ``length`` bytes at each position, by doubling the length of ranks that are already known."""
    known = _BYTES[np.frombuffer(data, np.uint8)]  # ranks of `step` bytes
    if len(data) < length:
        return known[:0]
    out, done, step = None, 0, 1
    while True:
        if length & step:
            if out is None:
                out = known
            else:
                n = len(data) - done - step + 1
                out = out[:n] * np.uint64(pow(_BASE, step, 1 << 64)) + known[done : done + n]
            done += step
        if done == length:
            return _mixed(out)
        known = known[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + known[step:]
        step *= 2


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        values = of(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, number of positions, whether a string may repeat within) of runs of positions with one key."""
    found = []
    n_positions = len(data) - LENGTH + 1
    for at in range(0, max(n_positions, 0), _PIECE):
        h = ranks(data[at : at + _PIECE + LENGTH - 1])
        least = _sliding(h, _WIDTH, np.minimum)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.append(first, len(least)))
        # Places whose rank is the key of some position; two of one rank close together lie in one stretch.
        padded = np.concatenate((np.zeros(_WIDTH - 1, np.uint64), least, np.zeros(_WIDTH - 1, np.uint64)))
        place = np.flatnonzero(_sliding(padded, _WIDTH, np.maximum) == h)
        twice = (h[place[1:]] == h[place[:-1]]) & (place[1:] - place[:-1] <= _WIDTH)
        inner = np.zeros(len(first), bool)
        inner[np.searchsorted(first, np.maximum(place[1:][twice] - _WIDTH + 1, 0), side="right") - 1] = True
        found.append((least[first], first + at, count, inner))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``_id``, ``_k``, ``_text``): rows with equal key and text have one identity."""
    t = whole(text)
    return docs.select(F.xxhash64(c(key).cast("string"), c(key).isNull(), F.sha2(t, 256)).alias("_id"), c(key).alias("_k"), t.alias("_text"))


def _keyed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts: list[tuple] = []

    def frame() -> pd.DataFrame:
        names = ["_id", "h", "e", "start", "inner"]
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
        return pd.DataFrame(dict(zip(names, columns)))

    held = 0
    for pdf in rows:
        for i, t in zip(pdf["_id"], pdf["_text"]):
            data = t.encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            h, start, count, inner = stretches(data)
            digest = xxhash.xxh64_intdigest
            e = np.fromiter((digest(data[s : s + n + LENGTH - 1]) for s, n in zip(start.tolist(), count.tolist())), np.uint64, len(h))
            parts.append((np.full(len(h), i), h.view(np.int64), e.view(np.int64), start << 32 | count, inner))
            held += len(h)
            if held >= _ROWS:
                yield frame()
                parts, held = [], 0
    yield frame()


def _opened(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of chosen stretches; where a key has too many, the ranks of their positions dealt out by salt."""
    names = ["h", "salt", "_id", "start", "single", "data", "places", "keys"]
    for pdf in rows:
        out = []
        for i, t, chosen in zip(pdf["_id"], pdf["_text"], pdf["chosen"]):
            data = t.encode("utf-8", "surrogatepass")
            for x in chosen:
                start, count = x["start"] >> 32, x["start"] & 0xFFFFFFFF
                piece = data[start : start + count + LENGTH - 1]
                if x["salts"] == 1:
                    out.append((x["h"], 0, i, start, x["single"], piece, None, None))
                    continue
                pairs = _pairs(piece)
                salt = (pairs % np.uint64(x["salts"])).astype(np.int64)
                for s in np.unique(salt).tolist():
                    own = np.flatnonzero(salt == s)
                    out.append((x["h"], s, i, start, x["single"], None, own.astype("<i8").tobytes(), pairs[own].tobytes()))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


def _pairs(piece: bytes) -> np.ndarray:
    """Rank of the 200 bytes at each position: the pair of the ranks there and 100 bytes on."""
    r = ranks(piece)
    n = len(piece) - LENGTH + 1
    return _mixed(r[:n] * np.uint64(_BASE) + r[GRAM : GRAM + n])


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte ranges of repeated strings in stretches that are the only ones of their rank."""
    out: list[tuple[int, int, int]] = []
    for g in runs(batches, ["h", "salt"]):
        places, keys, weight = [], [], []
        for data, p, k, single in zip(g["data"], g["places"], g["keys"], g["single"]):
            k = _pairs(data) if data is not None else np.frombuffer(k, np.uint64)
            keys.append(k)
            places.append(np.arange(len(k)) if data is not None else np.frombuffer(p, "<i8"))
            weight.append(np.full(len(k), 1 if single else 2))
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.bincount(which, np.concatenate(weight))[which] >= 2
        at = 0
        for i, start, single, p in zip(g["_id"].tolist(), g["start"].tolist(), g["single"], places):
            hit = p[often[at : at + len(p)]] if single else p[:0]
            at += len(p)
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) != 1) + 1
                for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(hit)).tolist()):
                    out.append((i, start + int(hit[a]), start + int(hit[b - 1]) + LENGTH))
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=["_id", "a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["_id", "a", "b"]).astype("int64")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(``_id``, ``ranges``): byte ranges of ``_text`` covered by repeated strings, neither merged nor sorted."""
    with small_batches(rows.sparkSession):
        return materialised(_ranges(rows))


def _ranges(rows: DataFrame) -> DataFrame:
    keyed = rows.select("_id", "_text").mapInPandas(_keyed, "_id long, h long, e long, start long, inner boolean")
    again = keyed.select("h", "inner").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where("n >= 2 OR inner")
    live = materialised(keyed.join(again.select("h"), "h", "left_semi"))
    whole_stretch = live.groupBy("h", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "start", "inner")).alias("x"))
    ranked = materialised(whole_stretch.select("h", "e", "n", "x.*"))
    kinds = ranked.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("any"))
    mixed = ranked.join(kinds.where("kinds >= 2 OR any"), "h")
    chosen = F.struct("h", "start", (F.col("n") == 1).alias("single"), F.ceil(F.col("kinds") / BLOCK).cast("long").alias("salts"))
    per_text = mixed.groupBy("_id").agg(F.collect_list(chosen).alias("chosen"))
    # Rows of one identity hold one text; one of them is enough.
    texts = rows.select("_id", "_text").join(per_text, "_id").select("_id", "_text", "chosen")
    shape = "h long, salt long, _id long, start long, single boolean, data binary, places binary, keys binary"
    opened = texts.mapInPandas(_opened, shape).repartition("h", "salt").sortWithinPartitions("h", "salt")
    found = opened.mapInPandas(_compared, "_id long, a long, b long")
    known = live.join(ranked.where("n >= 2").select("h", "e"), ["h", "e"], "left_semi").select(
        "_id", F.shiftright("start", 32).alias("a"), (F.shiftright("start", 32) + F.col("start").bitwiseAND(F.lit(0xFFFFFFFF)) + LENGTH - 1).alias("b")
    )
    return found.union(known).groupBy("_id").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in ranges:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _spans(cell) -> list[tuple[int, int]]:
    return merged([(x["a"], x["b"]) for x in cell]) if cell is not None else []


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``kept`` (binary), ``spans`` (removed byte ranges), one row per row.

    Removed is each byte covered by a 200-byte string that also starts elsewhere, in this or
    any other text of the table; all occurrences go. A null text counts as empty; texts below
    200 bytes stay whole; repeated rows remove each other; null keys stay null; an empty table
    gives an empty result. Very long texts are ranked in pieces, but their rows are whole.
    """
    rows = _identified(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (pdf.iloc[at : at + _OUT] for pdf in batches for at in range(0, len(pdf), _OUT)):
            data = [t.encode("utf-8", "surrogatepass") for t in part["_text"]]
            spans = [_spans(r) for r in part["ranges"]]
            yield pd.DataFrame(
                {
                    "_k": part["_k"].to_numpy(),
                    "n_bytes": [len(d) for d in data],
                    "kept": [without(d, s) for d, s in zip(data, spans)],
                    "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                }
            )

    done = rows.join(repeated_ranges(rows), "_id", "left").select("_k", "_text", "ranges")
    return done.mapInPandas(cut, f"_k {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>").withColumnRenamed("_k", key)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` and ``length``, if there is such a column, set anew.

    A character that a cut leaves incomplete is dropped. Every row stays, if need be with an
    empty text; null texts stay null. Repeated rows count as several documents, so strings of 200 bytes
    that they share are cut from all. Texts of any length are treated whole, in pieces; other columns
    pass through under any name; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        pieces = (without(t.encode("utf-8", "surrogatepass"), _spans(r)) for t, r in zip(texts, ranges))
        return pd.Series([p.decode("utf-8", "ignore") for p in pieces], dtype=object)

    t = whole(text)
    identity = F.xxhash64(c(key).cast("string"), c(key).isNull(), F.sha2(t, 256)).alias("_id")
    rows = docs.select(boxed(docs), identity, t.alias("_text"))
    done = rows.join(repeated_ranges(_identified(docs, key, text)), "_id", "left")
    new = F.when(F.col("ranges").isNull(), F.col("_text")).otherwise(kept("_text", "ranges"))
    done = done.withColumn("_new", F.when(F.col("_doc").getField(text).isNotNull(), new))

    def cell(n: str) -> Column:
        if n == text:
            return F.col("_new")
        return F.length("_new").cast(docs.schema[n].dataType) if n == length else F.col("_doc").getField(n)

    return done.select([cell(n).alias(n) for n in docs.columns])
