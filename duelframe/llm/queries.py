"""The registered queries of the text operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.llm import bpe, fim, fingerprint, jaccard, langid, lm, packing, quality, suffixes, toxicity, urlfilter, warc, whitening
from duelframe.llm.texts import SPACE, documents, remainder, table
from duelframe.session import materialised, remove_folder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --------------------------------------------------------------------------- 2: quality rules

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))

QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, ({_BITS})::BIGINT AS failures FROM m)
SELECT *, (failures & {quality.mask(quality.BASE)}) <> 0 AS base_failed,
  (failures & {quality.DEFAULT_POLICY.mask | quality.mask(quality.BASE)}) = 0 AS kept, '{quality.DEFAULT_POLICY.version}' AS policy FROM f
"""


@query(QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.quality_ledger(documents(spark, sf_dir)))


# --------------------------------------------------------------------------- 8: toxicity


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Fitted on the labelled ones of ``docs`` that are not held out."""
    return toxicity.fit_toxicity(toxicity.training_texts(docs, labels, remainder("_k", 4) != 2))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.toxicity_scores(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
        "n_passages",
        "worst_p",
    )


# --------------------------------------------------------------------------- 10: packing


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


# --------------------------------------------------------------------------- 9: url filters

#: The rules the query applies.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)

_RULE_ROWS = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)

URL_SQL = f"""
WITH rules(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT page_id, rhost || rpath AS rule, action,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
j AS (SELECT p.page_id, host, path, rule, action FROM p LEFT JOIN f ON f.page_id = p.page_id AND place = 1),
h AS (SELECT host, sum(CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN -1 ELSE 0 END) > 0 AS listed FROM j GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN h ON h.host = j.host
"""


@query(URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


# --------------------------------------------------------------------------- 4: language


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit_languages(langid.training_sample(docs, remainder("doc_id", 5) != 0))
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


# --------------------------------------------------------------------------- 5: fingerprints


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


# --------------------------------------------------------------------------- 7: byte pair encoding


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


# --------------------------------------------------------------------------- 6: language-model scores


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    in_train = remainder("doc_id", 7) != 2
    scored = lm.backoff_scores(docs, in_train)
    return scored.withColumn("held_out", remainder("doc_id", 7) == 2)


# --------------------------------------------------------------------------- 1: n-gram Jaccard join


@query()
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


# --------------------------------------------------------------------------- 3: repeated strings


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# --------------------------------------------------------------------------- 11: fill in the middle

FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""


@query(FIM_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.restore(fim.fill_in_middle(documents(spark, sf_dir))).drop("output", "restored")


# --------------------------------------------------------------------------- 12: whitening


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit_whitening(vectors)
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
    )


# --------------------------------------------------------------------------- 13: web archives

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again,
        min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM r
"""


@query(WARC_SQL)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = shared_folder(spark), shared_folder(spark)
    warc.write_arc(table(spark, sf_dir, "pages"), arcs)
    warc.arc_to_warc(spark, arcs, warcs)
    records = warc.read_warc(spark, warcs).where("record_type IN ('response', 'revisit')")
    found = materialised(
        records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
    )
    remove_folder(spark, arcs)
    remove_folder(spark, warcs)
    return found
