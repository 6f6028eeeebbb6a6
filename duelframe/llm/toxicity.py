"""Toxicity by maximum-scoring segments over token log-odds.

Learning: tokens of labelled texts are counted per class in Spark. The log-odds of a
token carry an informative Dirichlet prior: a token is shrunk towards the log-odds of
its first four letters, those towards the corpus. So a rare or unseen form of a known
stem is judged by its stem. The model keeps stems, and tokens that differ from theirs.

Scoring: each token adds its log-odds minus a drift, so a clean text scores downwards.
A linear scan (Ruzzo and Tompa) finds every maximal segment. Scores of the best segment
follow an extreme-value law in clean text, which turns score and length into a
p-value (Karlin and Altschul); a text adds up its significant segments, and a monotone
map fitted on the training texts makes a probability of that.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.texts import boxed, small_batches, unboxed, whole
from duelframe.layout import c
from duelframe.session import materialised

STEM = 4
#: At most so many labelled texts of either class are learned from; above it a hash of the key picks them.
MAX_TRAIN = 20_000
#: Prior weight of the stem for a token, of the corpus for a stem.
PRIOR = 4.0
#: What every token of ordinary text costs, so that only dense passages rise.
DRIFT = 0.6
#: Segments below this p-value count as significant.
ALPHA = 0.05
THRESHOLD = 0.3

_COUNTED = 100_000  # entries of a task's table of counts
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds of tokens and stems, the extreme-value law, and the calibration curve."""

    tokens: dict[str, float]
    stems: dict[str, float]
    rest: float
    scale: float  # lambda of the extreme-value law
    size: float  # its K
    knots: tuple[float, ...]
    levels: tuple[float, ...]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Only positive scores can start a segment, so the scan visits those and reads
    the running total in between from a cumulative sum.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # start, end, total before, total after, index of the last with a smaller total before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, end, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


def _scores(model: ToxicityModel, words: list[str]) -> np.ndarray:
    tokens, stems, rest = model.tokens.get, model.stems.get, model.rest
    out = np.empty(len(words))
    for i, w in enumerate(words):
        s = tokens(w)
        out[i] = stems(w[:STEM], rest) if s is None else s
    return out


def _passages(model: ToxicityModel, text: str) -> tuple[list[tuple[int, int, float, float]], int]:
    """Segments as (start, end, score, p-value), and the number of tokens."""
    words = _TOKEN.findall(text.lower())
    n = max(len(words), 1)
    found = segments(_scores(model, words)) if words else []
    return [(a, b, s, -math.expm1(-model.size * n * math.exp(-model.scale * s))) for a, b, s in found], len(words)


def _evidence(passages: list[tuple[int, int, float, float]]) -> float:
    """What a text has against it: minus log p of its segments, the best in full and further significant ones on top."""
    if not passages:
        return 0.0
    logs = sorted((-math.log(max(p, 1e-300)) for *_, p in passages), reverse=True)
    return logs[0] + sum(x for x in logs[1:] if x > -math.log(ALPHA))


def _calibrated(model: ToxicityModel, evidence: float) -> float:
    return float(np.interp(evidence, model.knots, model.levels))


def training_texts(docs: DataFrame, labels: DataFrame, chosen: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of labelled documents, thinned by a hash of the key to about ``max_train`` a class.

    The chosen keys are bounded by that, so they are broadcast; the sample is written once.
    """
    marked = labels.where(c(label).isin(0, 1) & c(key).isNotNull()).groupBy(c(key).alias("_k")).agg(F.max(c(label)).alias("_y"))
    marked = marked.where(chosen)
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        if n > max_train:  # the draw has 63 bits, so a class is never thinned to nothing
            drawn = F.call_function("shiftrightunsigned", F.xxhash64(F.col("_k")), F.lit(1)) < (max_train << 63) // n
        else:
            drawn = F.lit(True)
        keep = keep | ((F.col("_y") == y) & drawn)
    texts = docs.select(c(key).alias("_k"), whole(text).alias("_text"))
    return materialised(texts.join(F.broadcast(marked.where(keep)), "_k").select("_text", "_y"))


def _counted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold a token, and that hold a stem, per class; summed in tables of bounded size before the shuffle."""
    counts: dict[tuple[bool, str], list[int]] = {}

    def summed() -> pd.DataFrame:
        return pd.DataFrame([(s, w, a, b) for (s, w), (a, b) in counts.items()], columns=["stem", "word", "clean", "toxic"])

    for pdf in rows:
        for text, y in zip(pdf["_text"], pdf["_y"]):
            if len(counts) > _COUNTED:
                yield summed()
                counts.clear()
            words = set(_TOKEN.findall(text.lower()))
            for w in words:
                counts.setdefault((False, w), [0, 0])[y] += 1
            for w in {w[:STEM] for w in words}:
                counts.setdefault((True, w), [0, 0])[y] += 1
    yield summed()


def fit_toxicity(train: DataFrame) -> ToxicityModel:
    """Fit on (``_text``, ``_y``). Without both classes the model knows nothing and scores every text with the share of toxic ones.

    Counts are summed in Spark. The driver gets every stem and token that two of the
    training texts hold, whose number ``MAX_TRAIN`` bounds, and one histogram of fixed size per class.
    """
    with small_batches(train.sparkSession):
        return _fit_toxicity(train)


def _fit_toxicity(train: DataFrame) -> ToxicityModel:
    classes = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return ToxicityModel({}, {}, -1.0, 1.0, 1.0, (0.0,), (share,))
    counts = train.mapInPandas(_counted, "stem boolean, word string, clean long, toxic long").groupBy("stem", "word")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 2")
    found = counts.toPandas().sort_values("word")
    stem_rows, token_rows = (found[found["stem"] == s].reset_index(drop=True) for s in (True, False))

    # Counts are of documents: a class with k of n documents has the rate (k + prior) / (n + all priors).
    def odds(clean, toxic, mean):
        """Log-odds with the prior mean expressed as ``PRIOR`` documents split by the odds of ``mean``."""
        up = np.exp(mean) * n1 / n0
        extra = PRIOR * up / (1 + up)
        return np.log((toxic + extra) / (n1 + PRIOR)) - np.log((clean + PRIOR - extra) / (n0 + PRIOR))

    stem_odds = odds(stem_rows["clean"].to_numpy(), stem_rows["toxic"].to_numpy(), np.zeros(len(stem_rows)))
    z = lambda rows, o: o * np.sqrt(np.minimum(rows["clean"] + rows["toxic"], rows["toxic"] + PRIOR * 4))
    stems = dict(zip(stem_rows["word"], np.where(np.abs(z(stem_rows, stem_odds)) > 2, stem_odds, np.minimum(stem_odds, 0))))
    mean = token_rows["word"].str[:STEM].map(stems).fillna(0.0).to_numpy(dtype=float)
    token_odds = odds(token_rows["clean"].to_numpy(), token_rows["toxic"].to_numpy(), mean)
    sure = (np.abs(token_odds - mean) * np.sqrt(token_rows["clean"] + token_rows["toxic"])).to_numpy() > 3
    tokens = {w: o for w, o, k in zip(token_rows["word"], token_odds, sure) if k}
    clip = lambda d: {w: float(min(max(o, -2.0), 6.0) - DRIFT) for w, o in d.items()}
    raw = ToxicityModel(clip(tokens), clip(stems), -DRIFT, 1.0, 1.0, (0.0,), (share,))
    return _calibrate(train, raw, n0, n1)


_BINS = np.concatenate(([-1.0], np.linspace(0, 60, 241)))


def _calibrate(train: DataFrame, raw: ToxicityModel, n0: int, n1: int) -> ToxicityModel:
    """Lambda and K from the token scores of clean texts, then the share of toxic texts by evidence."""

    def spectrum(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            seen: dict[float, int] = {}
            for text, y in zip(pdf["_text"], pdf["_y"]):
                if y == 0:
                    for s, n in zip(*np.unique(np.round(_scores(raw, _TOKEN.findall(text.lower())), 1), return_counts=True)):
                        seen[float(s)] = seen.get(float(s), 0) + int(n)
            yield pd.DataFrame(list(seen.items()), columns=["s", "n"])

    spread = train.mapInPandas(spectrum, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    s, p = spread["s"].to_numpy(), spread["n"].to_numpy() / max(spread["n"].sum(), 1)
    low, high = 1e-3, 1.0  # the positive root of sum p exp(lambda s) = 1
    grows = lambda x: float((p * np.exp(x * s)).sum()) > 1
    if len(s) and s.max() > 0 and float((p * s).sum()) < 0:
        while not grows(high) and high < 50:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if grows(mid) else (mid, high)
    scale = high
    size = float(max(-(p * s).sum(), 1e-3) * scale) if len(s) else 1.0  # the usual approximation, K = lambda |drift|
    law = ToxicityModel(raw.tokens, raw.stems, raw.rest, scale, min(size, 1.0), raw.knots, raw.levels)

    def evidence(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            found = np.array([_evidence(_passages(law, t)[0]) for t in pdf["_text"]])
            bins = np.searchsorted(_BINS, found, side="left")
            for y in (0, 1):
                b, n = np.unique(bins[pdf["_y"].to_numpy() == y], return_counts=True)
                yield pd.DataFrame({"b": b.astype("int64"), "y": y, "n": n.astype("int64")})

    table = train.mapInPandas(evidence, "b long, y int, n long").groupBy("b", "y").agg(F.sum("n").alias("n")).toPandas()
    clean, toxic = (np.zeros(len(_BINS) + 1) for _ in range(2))
    for b, y, n in table.itertuples(index=False):
        (toxic if y else clean)[b] = n
    clean, toxic = clean / clean.sum() * n0, toxic / toxic.sum() * n1
    # Pool adjacent violators: the share of toxic texts must not fall with the evidence.
    pools: list[list[float]] = []
    edges = np.concatenate((_BINS, [_BINS[-1] + 1]))
    for x, a, b in zip(edges, clean, toxic):
        if a + b == 0:
            continue
        pools.append([x, x, a, b])
        while len(pools) > 1 and pools[-2][3] * (pools[-1][2] + pools[-1][3]) >= pools[-1][3] * (pools[-2][2] + pools[-2][3]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots, levels = [], []
    for first, last, a, b in pools:
        level = (b + 0.5 * n1 / (n0 + n1)) / (a + b + 0.5)
        for x in (first, last):
            if not knots or x > knots[-1]:
                knots.append(float(x))
                levels.append(float(max(level, levels[-1] if levels else 0.0)))
    return ToxicityModel(law.tokens, law.stems, law.rest, law.scale, law.size, tuple(knots), tuple(levels))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """``key``, ``score``, ``n_passages``, ``worst_p``; with ``spans`` also the significant passages as token ranges.

    A null or empty text has no evidence and gets the lowest calibrated score. Repeated
    rows are scored alike, one by one; a null key stays null; an empty table gives an
    empty result. Texts are scanned whole; memory is one text and one Arrow batch.
    """
    passage = "array<struct<start:long,end:long,score:double,p:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in rows:
            out = []
            for text in pdf["_text"]:
                found, _ = _passages(m, text)
                marked = [x for x in found if x[3] <= ALPHA]
                out.append((_calibrated(m, _evidence(found)), len(marked), min((x[3] for x in found), default=1.0), marked if spans else []))
            done = pd.DataFrame(out, columns=["score", "n_passages", "worst_p", "passages"])
            yield pd.concat([pdf.drop(columns="_text").reset_index(drop=True), done], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    df = docs.select(c(key).alias("_k"), whole(text).alias("_text")).mapInPandas(
        run, f"_k {kind}, score double, n_passages long, worst_p double, passages {passage}"
    )
    return df.select(F.col("_k").alias(key), "score", "n_passages", "worst_p", *(["passages"] if spans else []))


def keep_civil(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and no others.

    Null and empty texts have no evidence against them; each of repeated rows is judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return texts.map(lambda t: _calibrated(m, _evidence(_passages(m, t)[0])))

    boxed_rows = docs.select(boxed(docs), whole(text).alias("_text")).withColumn("_score", score("_text"))
    return unboxed(boxed_rows.where(F.col("_score") < threshold), docs.columns)
