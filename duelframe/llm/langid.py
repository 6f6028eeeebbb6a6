"""Language by the nearest of several centroids per language.

A text becomes counts of its letters' 1-, 2- and 3-grams, hashed to a fixed number of
columns, weighted by TF-IDF and normalised. Each language has a few centroids, found by
spherical k-means over a bounded sample of its texts. A text gets the language of the
centroid with the largest cosine; one that is far from all of them is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c
from duelframe.llm.texts import whole
from duelframe.session import materialised

UNKNOWN = "und"
WIDTH = 4096
#: Bound of the training sample: about so many texts of each language, chosen by a hash of the key.
SAMPLE = 1_000
CENTROIDS = 4
#: Sizes of so many languages may be sent to every task; a column with more values is joined by shuffling.
FEW_LANGUAGES = 10_000
#: Texts further from their centroid than all but this share of the training texts count as rejected.
REJECT = 0.01
_PIECE = 1 << 20  # characters counted at once, which bounds the working arrays of very long texts


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: dict[str, float]  # cosine below which a text is rejected


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str, width: int = WIDTH) -> np.ndarray:
    """Counts of hashed letter n-grams; whatever is no letter becomes one word border."""
    total = np.zeros(width)
    for at in range(0, max(len(text), 1), _PIECE):
        piece = text[max(at - 2, 0) : at + _PIECE].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        letter = _is_letter(codes)
        codes = np.where(letter, codes, 32)
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = codes[keep]
        g1 = codes[codes != 32]
        g2 = codes[:-1] * np.uint64(0x1F123BB5) + codes[1:]
        g3 = g2[:-1] * np.uint64(0x1F123BB5) + codes[2:] if len(codes) > 2 else g2[:0]
        for n, g in enumerate((g1, g2, g3)):
            h = (g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x51ED2701)) >> np.uint64(40)
            total += np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width)
    return total


_LETTERS = np.zeros(0x110000, bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Letters by code point; the table is filled on first use."""
    if not _LETTERS.any():
        _LETTERS[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTERS[codes.astype(np.int64)]


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _counted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        counts = [gram_counts(t).astype("<f4").tobytes() for t in pdf["_text"]]
        yield pd.DataFrame({"_lang": pdf["_lang"], "counts": counts})


def training_sample(docs: DataFrame, chosen: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(``_lang``, ``_text``) of about ``sample`` texts of each language among the ``chosen`` rows that have one."""
    known = docs.where(chosen & c(lang).isNotNull() & c(text).isNotNull())
    rows = known.select(c(lang).alias("_lang"), whole(text).alias("_text"), F.xxhash64(c(key).cast("string"), c(lang)).alias("_draw"))
    sizes = materialised(known.groupBy(c(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n")))
    if sizes.count() <= FEW_LANGUAGES:
        sizes = F.broadcast(sizes)  # texts stay where they are
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("_n"))
    drawn = F.pmod(F.col("_draw"), F.lit(1 << 30)) < F.floor(share * F.lit(float(1 << 30)))
    return rows.join(sizes, "_lang").where(drawn).select("_lang", "_text")


def _clustered(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means, started from texts spread over the sample by farthest-first choice."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        new = np.stack([vectors[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    sizes = np.bincount(np.argmax(vectors @ centres.T, axis=1), minlength=len(centres))
    return centres[sizes >= max(2, 0.02 * len(vectors))] if (sizes >= max(2, 0.02 * len(vectors))).any() else centres


def fit_languages(train: DataFrame, centroids: int = CENTROIDS) -> LanguageModel | None:
    """Fit on a bounded sample (``_lang``, ``_text``); None without any.

    Counting runs in Spark; the driver clusters at most languages times ``SAMPLE`` vectors.
    """
    sample = train.mapInPandas(_counted, "_lang string, counts binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["_lang", "counts"], kind="stable").reset_index(drop=True)
    counts = np.stack([np.frombuffer(x, "<f4") for x in sample["counts"]])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = np.log1p(counts) * idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    names, centres, floor = [], [], {}
    for name in sorted(set(sample["_lang"])):
        own = vectors[(sample["_lang"] == name).to_numpy()]
        found = _clustered(own, centroids)
        names += [name] * len(found)
        centres.append(found)
        floor[name] = float(np.quantile((own @ found.T).max(axis=1), REJECT))
    return LanguageModel(tuple(names), idf, np.concatenate(centres), floor)


def identify(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``.

    A null text, one without a letter, and every text without a model gets ``und``, score 0,
    rejected. Repeated rows are judged alike, one by one; ties go to the first language by
    name; a null key stays null; an empty table gives an empty result. Texts are counted
    whole, in pieces of a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in rows:
            out = []
            for t in pdf["_text"]:
                if m is None or not has_letter(t):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                cosine = m.centroids @ _vector(gram_counts(t), m.idf)
                best = int(np.argmax(cosine))
                name, score = m.languages[best], float(min(max(cosine[best], 0.0), 1.0))
                out.append((name, score, score < m.floor[name]))
            done = pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
            yield pd.concat([pdf[["_k"]].reset_index(drop=True), done], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    df = docs.select(c(key).alias("_k"), whole(text).alias("_text"))
    return df.mapInPandas(run, f"_k {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_k", key)
