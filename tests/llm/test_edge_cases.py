"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest

import corpus_pipeline
from duelframe.llm import bpe, fingerprint, jaccard, langid, lm, packing, quality, suffixes, toxicity, urlfilter
from duelframe.session import materialised
from pyspark.sql import functions as F


def language(docs):
    return langid.identify(docs, langid.fit_languages(langid.training_sample(docs, F.lit(True))))


def language_model(docs):
    return lm.backoff_scores(docs, F.lit(True))


def toxic(docs):
    labels = docs.select("doc_id", (F.col("doc_id") == 9).cast("int").alias("toxic"))
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(toxicity.training_texts(docs, labels, F.lit(True))), spans=True)


OPERATORS = {
    "quality": lambda d: quality.apply_policy(quality.quality_ledger(d)),
    "toxicity": toxic,
    "language": language,
    "fingerprint": fingerprint.compare_edited,
    "jaccard": jaccard.near_duplicates,
    "suffixes": suffixes.remove_repeats,
    "lm": language_model,
    "bpe": lambda d: bpe.encoded(d, public_tokenizers.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(documents, messy, name):
    docs = documents(messy)
    rows = OPERATORS[name](docs).collect()
    order = lambda ids: sorted(ids, key=lambda i: (i is not None, i))
    assert order(r["doc_id"] for r in rows) == order(i for i, _ in messy)
    twins = [r.asDict() for r in rows if r["doc_id"] == 5]
    if name != "fingerprint":  # there the second of two equal rows has another successor
        assert twins[0] == twins[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(documents, name):
    assert OPERATORS[name](documents([])).count() == 0


@pytest.mark.parametrize("trained", [True, False])
def test_all_ngrams_on_messy_and_empty_tables(documents, messy, trained):
    for rows in (messy, []):
        docs = documents(rows)
        found = lm.backoff_scores(docs, F.lit(trained))
        scored = found.collect()
        assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(i) for i, _ in rows)
        assert found.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        assert len({tuple(r) for r in scored if r["doc_id"] == 5}) == min(len(rows), 1)
        assert all(r["score"] < 0 if trained else r["score"] == 0 for r in scored)


def test_packing_of_messy_and_empty_tables(documents, messy):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(documents(messy), path).collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in messy}
    assert [(p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] in (1, 2)] == [(1, 1)] * 2
    assert packing.pack(documents([]), path).count() == 0


def test_url_filters_on_messy_and_empty_tables(spark):
    rules = (urlfilter.Rule("block", "org", "/"),)
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.org/x?y"), (4, "http://A.org/x?y"), (None, "://org/"), (6, "http://" + "a." * 3000 + "org/"), (7, "x://h#/p")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, verdict string")
    found = sorted(((r["page_id"], r["host"][:6], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, rules).collect()), key=str)
    assert found == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "/x", "org/", "block"),
            (4, "a.org", "/x", "org/", "block"), (None, "org", "/", "org/", "block"), (6, "a.a.a.", "/", "org/", "block"), (7, "h", "", None, "allow"),
        ],
        key=str,
    )
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert urlfilter.filter_urls(pages, ()).where("verdict = 'block'").count() == 0


def test_pipeline_stages_on_messy_and_empty_tables(spark, documents, messy, tmp_path):
    labels = spark.createDataFrame([(9, 1, 1), (4, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (messy, []):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes, name
            out.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_rows_that_stages_keep_of_messy_tables(spark, documents, messy, tmp_path):
    """Which rows every stage keeps, and their texts, each stage on the whole messy table."""
    labels = spark.createDataFrame([(9, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = documents(messy), dict(corpus_pipeline.STAGES)
    order = lambda rows: sorted(rows, key=str)
    kept = {n: order((r["doc_id"], r["text"]) for r in stages[n](spark, docs, str(tmp_path)).collect()) for n in ("quality", "toxicity", "near_duplicates", "repeats")}
    assert kept["quality"] == [(7, dict(messy)[7])]  # every other text has under 50 words
    model = corpus_pipeline.toxicity_model(docs, labels)
    civil = {r["doc_id"] for r in toxicity.toxicity_scores(docs, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert kept["toxicity"] == order((i, t) for i, t in messy if i in civil)
    texts = dict(messy)
    assert kept["near_duplicates"] == order([(i, t) for i, t in messy if i not in (5, 6)] + [(5, texts[5])])
    cut = {7: texts[7].rstrip("x"), 8: " ünïcode 日本語 \U0001f600", 10: ""}
    assert kept["repeats"] == order((i, cut.get(i, t)) for i, t in messy)


def test_repeated_rows_leave_one_row_that_stays_whole(spark, documents):
    clean = " ".join(f"clean{i}" for i in range(80))
    near = clean.replace("clean79", "other")
    alone = " ".join(f"alone{i}" for i in range(80))
    third = " ".join(f"third{i}" for i in range(80))
    # A row twice; another class under the same key; a repeated row of that class under a greater key; a class whose least key is taken.
    rows = [(1, clean), (1, clean), (2, near), (1, alone), (3, alone), (3, third), (4, third), (None, near), (None, ""), (None, ""), (5, None)]
    kept = materialised(jaccard.keep_one(documents(rows)))
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, clean), (1, alone), (3, third), (None, ""), (None, ""), (5, None)], key=str)
    texts = sorted((r["text"] for r in suffixes.drop_repeats(kept).collect()), key=str)
    assert texts == sorted([clean, alone, third, "", "", None], key=str)


def test_pipeline_chain(spark, documents, tmp_path):
    good = " ".join(f"plain{i % 90} text{i}" for i in range(80))
    near = good.replace("text79", "other")
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [(1, good), (2, good), (3, near), (4, "too short"), (5, None), (6, "spam " * 100), (7, f"{shared} {'begin '}" + " ".join(f"u{i}" for i in range(200))),
            (8, " ".join(f"w{i}" for i in range(200)) + f" close {shared}")]
    documents(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows, extra=False)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialised(stage(spark, docs, str(tmp_path)))
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[1, 2, 3, 7, 8]] * 2 + [[1, 7, 8]] * 2
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert texts[1] == (good, len(good))
    assert "passage30" not in texts[7][0] + texts[8][0] and texts[7][1] == len(texts[7][0])
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == {1, 7, 8}
