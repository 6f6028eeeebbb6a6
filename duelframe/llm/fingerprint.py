"""Document fingerprints by content-defined chunking.

A text is normalised (lower case, white space runs become one space) and cut where a
gear hash over its bytes has a run of zero bits, so an edit moves only the cuts near it.
A fingerprint is the set of chunk digests with their lengths; the likeness of one text
to another is the share of its length whose chunks the other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.layout import c
from duelframe.llm.texts import whole

#: Chunk sizes in bytes: mean distance of cuts beyond the least size, least size, greatest size.
MEAN, LEAST, GREATEST = 64, 16, 512
_PIECE = 1 << 20

# The gear table: 256 reproducible random words.
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), "<u4")


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split())


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[data[i]] in 32 bits, hence a hash of the last 32 bytes, by doubling windows."""
    h = _GEAR[np.frombuffer(data, np.uint8)].copy()
    step = 1
    while step < 32 and step < len(h):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last one at the end of the data."""
    found: list[np.ndarray] = []
    for at in range(0, len(data), _PIECE):
        before = min(at, 31)
        h = gear_hashes(data[at - before : at + _PIECE])[before:]
        found.append(np.flatnonzero(h >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + at + 1)
    ends, last = [], 0
    for cut in (np.concatenate(found).tolist() if found else []) + [len(data)]:
        while cut - last > GREATEST:
            last += GREATEST
            ends.append(last)
        if cut - last >= LEAST or cut == len(data) > last:
            ends.append(cut)
            last = cut
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest to length of every distinct chunk."""
    data = normalised(text)
    out: dict[int, int] = {}
    last = 0
    for end in cuts(data):
        piece = data[last:end]
        out[xxhash.xxh64_intdigest(piece)] = len(piece)
        last = end
    return out


def fingerprint(parts: dict[int, int]) -> str:
    """``digest:length`` of the chunks in the order of digests, hexadecimal."""
    return ",".join(f"{d:016x}:{n:x}" for d, n in sorted(parts.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the length of a's chunks that b has too; two empty texts are alike, an empty and another are not."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / total


def containment(a: str, b: str) -> float:
    """``likeness`` of two fingerprints."""
    parsed = [{int(d, 16): int(n, 16) for d, n in (x.split(":") for x in f.split(",") if x)} for f in (a, b)]
    return likeness(*parsed)


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the start of ``following``, as many code points or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint``: one row per row. Null counts as empty, which has the empty fingerprint."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(chunks(t)))

    return docs.select(c(key), of(whole(text)).alias("fingerprint"))


# --------------------------------------------------------------------------- neighbours in the order of keys


def _range_of(spark: SparkSession, key: Column, bounds: list[float]) -> Column:
    """Number of bounds up to the key. The bounds, a few for each task, are broadcast instead of written into the plan."""
    sent = spark.sparkContext.broadcast(np.array(bounds, float))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, keys.to_numpy(float), side="right").astype(np.int32))

    return place(key) if bounds else F.lit(0)


def with_next(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows (``_part``, ``_k``, ``_ahead``, ``_text``) arranged so that one pass over a sorted part sees every row's successor.

    Keys are dealt into about ``parts`` ranges by quantiles. The first row of each range is
    also sent to the range before it, and the very first row to the last range, marked
    ``_ahead``; so texts are shuffled once and no task orders more than its ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(c(key).alias("_k"), whole(text).alias("_text"))
    bounds = sorted(set(rows.approxQuantile("_k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    number = F.coalesce(F.col("_k").cast("double"), F.lit(float("-inf")))
    rows = rows.withColumn("_part", _range_of(spark, number, bounds))
    firsts = rows.groupBy("_part").agg(F.min("_k").alias("k"), F.max(F.col("_k").isNull()).alias("none"))
    found = sorted((r["_part"], None if r["none"] else r["k"]) for r in firsts.collect())  # at most `parts` rows
    heads = [(p, k, found[i - 1][0]) for i, (p, k) in enumerate(found)]
    if not heads:
        return rows.select("_part", "_k", F.lit(False).alias("_ahead"), "_text")
    kind = docs.schema[key].dataType.simpleString()
    heads = F.broadcast(spark.createDataFrame(heads, f"p int, k {kind}, before int"))
    same = (F.col("_part") == F.col("p")) & F.col("_k").eqNullSafe(F.col("k"))
    ahead = rows.join(heads, same).groupBy(F.col("before").alias("_part"), "_k").agg(F.min("_text").alias("_text"))
    return rows.select("_part", "_k", F.lit(False).alias("_ahead"), "_text").unionByName(ahead.withColumn("_ahead", F.lit(True)))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next text's are.

    Columns: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. The next document is the one with the next key, after the
    last the first; equal keys are ordered by text, null keys come first. A null text counts
    as empty, and texts of any length are fingerprinted whole. A table of one row is its own successor; an
    empty table gives an empty result; other columns are not looked at.
    Keys are numbers; ``parts`` is the number of key ranges, eight for each shuffle partition.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = with_next(docs, key, text, parts or 8 * tasks)
    dealt = rows.repartition(tasks, "_part").sortWithinPartitions("_part", "_ahead", F.col("_k").isNotNull(), "_k", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # part, key, text, chunks of the row that waits for its successor
        for pdf in batches:
            out = []
            for p, k, ahead, t in zip(pdf["_part"], pdf["_k"], pdf["_ahead"], pdf["_text"]):
                own = chunks(t)
                if last is not None and last[0] == p:
                    edited = edited_text(last[2], t)
                    changed = chunks(edited)
                    out.append(
                        (
                            last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            fingerprint(last[3]), fingerprint(changed), likeness(last[3], changed), likeness(last[3], own),
                        )
                    )
                last = None if ahead else (p, k, t, own)
            yield pd.DataFrame(out, columns=["_k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema[key].dataType.simpleString()
    return dealt.mapInPandas(
        run, f"_k {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("_k", key)
