"""Operators compared with plain versions that look at everything."""

import hashlib
import importlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from duelframe.llm import bpe, components, fingerprint, jaccard, lm, packing, quality, suffixes, texts, toxicity, urlfilter
from duelframe.session import materialised

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in WHITE.split(text or "") if w]


@pytest.fixture(scope="module")
def corpus(documents):
    """Copies, near copies of many degrees, shared passages, repeated lines and periodic text."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for _ in range(60):  # a chain of edits: some pairs are above the threshold, some below
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    for i in range(20):
        own = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(2)]
        rows.append(f"{own[0]} {passage[: 120 + 10 * i]} {own[1]}")
    rows += ["line one\nline one\nline two and more\n" * 9, "ab" * 300, "abc" * 150, "é" * 260, base[0], " ".join(base[:4]), None, ""]
    rows += [rows[0]] * 7 + [rows[61]] * 3
    rng.shuffle(rows)
    found = list(enumerate(rows))
    return documents(found), found


# --------------------------------------------------------------------------- 1


def test_jaccard_links(corpus):
    docs, rows = corpus
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    near = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                near[i].add(j)
    classes = {}
    for i in sets:
        if i not in classes:
            queue, seen = [i], {i}
            while queue:
                new = near[queue.pop()] - seen
                seen |= new
                queue += new
            classes |= dict.fromkeys(seen, min(seen))
    assert any(len(near[i]) > 3 for i in sets)
    for r in jaccard.near_duplicates(docs).collect():
        i = r["doc_id"]
        others = {sets[j] for j in near[i]} - {sets[i]}
        assert (r["class_id"], r["n_links"], r["n_text_links"]) == (classes[i], len(near[i]), len(others))
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert kept == set(classes.values())


def test_small_blocks_find_the_same(corpus, monkeypatch):
    docs, _ = corpus
    want = sorted(jaccard.near_duplicates(docs).collect())
    monkeypatch.setattr(jaccard, "NODE_BLOCK", 4)
    monkeypatch.setattr(jaccard, "CLUSTER_TEXTS", 5)
    assert sorted(jaccard.near_duplicates(docs).collect()) == want


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert jaccard.prefix_depth() == 6
    assert jaccard.prefix_depth(threshold=0.6) < 6
    for t in (0.5, 0.7, 0.8, 0.9):
        d = jaccard.prefix_depth(threshold=t)
        assert d == 1 or 1 - (1 - t**d) ** jaccard.TREES >= jaccard.RECALL


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r["v"]: r["root"] for r in components.components(edges).collect()}
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


# --------------------------------------------------------------------------- 2


def test_quality_measures(corpus):
    docs, rows = corpus
    by_id = dict(rows)
    for r in quality.apply_policy(quality.quality_ledger(docs)).collect():
        text = by_id[r["doc_id"]] or ""
        w = words_of(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[n] for n in quality.MEASURES[:5]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_policies_and_ablation_read_the_ledger(spark):
    ledger = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 16), (5, 16), (6, 17)], "doc_id long, failures long")
    found = {r["rule"]: tuple(r)[1:] for r in quality.ablation(ledger).collect()}
    assert found["few_words"] == (3, 1, 2) and found["symbols"] == (3, 2, 3) and found["long_words"] == (0, 0, 1)
    loose = quality.policies(ledger, {"v0": quality.Policy("v0", ("few_words",))}).where("kept_v0")
    assert {r["doc_id"] for r in loose.collect()} == {1, 4, 5}


# --------------------------------------------------------------------------- 3


def brute_spans(rows):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    spans = {}
    for i, b in data.items():
        spans[i] = suffixes.merged([(j, j + 200) for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1])
    return data, spans


@pytest.mark.parametrize("block", [None, 2])
def test_repeated_bytes(corpus, monkeypatch, block):
    if block:
        monkeypatch.setattr(suffixes, "BLOCK", block)
    docs, rows = corpus
    data, spans = brute_spans(rows)
    assert sum(len(s) > 0 for s in spans.values()) > 20
    for r in suffixes.remove_repeats(docs).collect():
        i = r["doc_id"]
        assert [tuple(s) for s in r["spans"]] == spans[i]
        assert bytes(r["kept"]) == suffixes.without(data[i], spans[i]) and r["n_bytes"] == len(data[i])


def test_long_texts_are_ranked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 333)
    rng = random.Random(5)
    part = "".join(rng.choice("abcdef ") for _ in range(700))
    texts_ = ["".join(rng.choice("abc") for _ in range(900)) + part, part[100:600] + "zz" * 200, part[350:] + "q"]
    for t in texts_:
        data = t.encode()
        key, start, count, _ = suffixes.stretches(data)
        assert count.sum() == len(data) - 199 and (np.diff(start) == count[:-1]).all()
    h = suffixes.ranks(part.encode(), 100)
    assert len(set(h.tolist())) == len({part[i : i + 100] for i in range(601)})


# --------------------------------------------------------------------------- 5


def test_chunks_resist_shifts():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    a, b = fingerprint.chunks(text), fingerprint.chunks("some new words " + text)
    assert fingerprint.likeness(a, b) > 0.98 and fingerprint.likeness(a, fingerprint.chunks(text[::-1])) == 0
    assert fingerprint.containment(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) == fingerprint.likeness(a, b)
    assert fingerprint.chunks("A  b\n") == fingerprint.chunks("a b")


def plain_fingerprint(text):
    """Chunk by chunk with a byte at a time; a cut follows a byte after which the low bits of the hash are zero."""
    data, out, start, h = fingerprint.normalised(text), {}, 0, 0
    ends = set(fingerprint.cuts(data))
    for i in range(len(data)):
        if i + 1 in ends:
            out[xxhash.xxh64_intdigest(data[start : i + 1])] = i + 1 - start
            start = i + 1
    return ",".join(f"{d:016x}:{n:x}" for d, n in sorted(out.items()))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_every_text_meets_the_next_one(spark, documents, parts):
    rng = random.Random(parts)
    rows = [(i * 3 - 40, "".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 400)))) for i in range(70)]
    found = {r["doc_id"]: r for r in fingerprint.compare_edited(documents(rows), parts=parts).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        own, changed = fingerprint.chunks(t), fingerprint.chunks(edited)
        assert r["near_next"] == fingerprint.likeness(own, fingerprint.chunks(n)) and r["near_edited"] == fingerprint.likeness(own, changed)
        assert r["fingerprint"] == plain_fingerprint(t) and r["edited_fingerprint"] == plain_fingerprint(edited)


def test_gear_hash_is_the_sequential_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(fingerprint._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fingerprint.gear_hashes(data).tolist() == want


# --------------------------------------------------------------------------- 6


def test_probabilities_of_every_state_add_up_to_one(corpus):
    """The whole automaton of one bucket, whose questions are answered without Spark."""
    lists = [lm.tokens(t or "") for _, t in corpus[1]]
    flat = [w for words in lists for w in words]
    words = sorted(set(flat), key=lambda w: lm._hashes([w])[0])
    place = {w: i for i, w in enumerate(words)}
    ids = np.array([place[w] for w in flat], np.int32)
    packed = zlib.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
    m = lm._Bucket(lm._rising(lm._hashes(words)), packed, [len(x) for x in lists], [True] * len(lists))

    def answers(keys, times):
        return [cell for pdf in lm._counted(iter([lm._questions(0, keys, times, 1)])) for cell in pdf["x"]]

    m.hear_pairs(answers(*m.ask_pairs()))
    m.hear_triples(answers(*m.ask_triples()))
    two, one = np.flatnonzero(m.n2 >= lm.FLOOR), np.flatnonzero(m.n1 >= lm.FLOOR)
    m.failing, m.wanted = (two, one), np.concatenate((m.h2[two], m.h[one]))
    keys, sums = m.sums()
    question = pd.DataFrame({"shard": [0], "bucket": [0], "x": [lm._rising(keys)], "y": [lm._planes(sums.reshape(-1))], "wanted": [lm._rising(np.sort(m.wanted))]})
    model = m.automaton([next(lm._summed(iter([question])))["x"][0]], len(flat), len(words))
    unknown = math.log10(lm.unigram(0, len(flat), len(words)))
    model.root.append(unknown)  # an id that no arc has
    model.enter.append(0)
    states = {0, *model.target, *model.enter}
    assert len(model.arcs) == len(two) + np.count_nonzero(m.n3 >= lm.FLOOR)
    assert states == {0, *(a // model.width for a in model.arcs)}
    for state in random.Random(0).sample(sorted(states), 12):
        s, rest = state, unknown
        while s:
            rest += model.backoff[s]
            s = model.fail[s]
        assert sum(10 ** model.walk([w], state) for w in range(len(words))) + 10**rest == pytest.approx(1)


@pytest.mark.parametrize("small", [False, True])
def test_every_repeated_ngram_counts(spark, corpus, monkeypatch, tmp_path, small):
    """The query against a model that holds all n-grams."""
    docs, rows = corpus
    if small:
        monkeypatch.setattr(lm, "BUCKET", 2_000)
        monkeypatch.setattr(lm, "SHARD", 700)
    rows = [*rows, (None, "a row without a key"), (None, rows[0][1])]
    docs.sparkSession.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split = [(i, ["\n", *words_of((t or "").lower()), "\n"], zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2) for i, t in rows]
    n = Counter()
    for _, w, own in split:
        if own:
            n.update([(x,) for x in w[1:]] + list(zip(w, w[1:])) + list(zip(w, w[1:], w[2:])))
    total, types = sum(v for g, v in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    after = defaultdict(list)
    for g, v in n.items():
        if len(g) > 1 and v >= 2:
            after[g[:-1]].append(g)

    def p(g):
        if len(g) == 1:
            return lm.unigram(n[g], total, types)
        if n[g] >= 2:
            return (n[g] - 0.6) / n[g[:-1]]
        arcs = after[g[:-1]]
        return (1 - sum(map(p, arcs))) / (1 - sum(p(x[1:]) for x in arcs)) * p(g[1:])

    def fields(i, w):
        grams = [w[max(0, j - 2) : j + 1] for j in range(1, len(w))]
        base = sum(math.log10(lm.base(n[(x,)], total, types)) for x in w[1:])
        return str(i), len(w) - 1, sum(n[(x,)] > 0 for x in w[1:]), total, base, sum(math.log10(p(tuple(g))) for g in grams)

    want = sorted(fields(i, w) for i, w, _ in split)
    query = importlib.import_module("duelframe.llm.queries").QUERIES["op6_lm_scoring"]
    found = sorted((str(r[0]), *tuple(r)[1:6]) for r in query(spark, str(tmp_path)).collect())
    assert [f[:4] for f in found] == [w[:4] for w in want]
    for f, w in zip(found, want):
        assert f[4:] == pytest.approx(w[4:])


# --------------------------------------------------------------------------- 7 and 10


def test_bpe_is_the_librarys(spark, documents, corpus, messy):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    odd = ["don't we'Re İ Σας ΣΑΣ ẞ ﬁ 12½", "a\x1c\x1d\x85b​　c", "<|startoftext|>x<|endoftext|>", "ab" * 900, "!?" * 400]
    letters = [chr(i) for i in range(32, 0x1F000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] != "M"]
    odd += ["".join(rng.choice(letters) for _ in range(80)) for _ in range(400)]
    rows = list(enumerate([t for _, t in corpus[1]] + [t for _, t in messy] + odd))
    by_id = dict(rows)
    for r in bpe.encoded(documents(rows), path).collect():
        want = library.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    coder = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(300):
        parts = [coder.inner[rng.randrange(97, 123)] for _ in range(rng.randrange(1, 60))]
        assert coder._scanned(list(parts)) == coder._queued(list(parts))


def test_packing_is_a_partition_of_all_tokens(documents, corpus, messy, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = list(enumerate([t for _, t in corpus[1]] + [t for _, t in messy]))
    pieces = packing.pack(documents(rows), path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_nnls_uses_up_a_histogram_made_of_combinations():
    found = packing.combinations(16)
    a = np.zeros((16, len(found)))
    for j, q in enumerate(found):
        for k in q:
            a[k, j] += 1
    x = np.zeros(len(found))
    x[[0, 3, 9]] = 5, 2, 7
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-2


# --------------------------------------------------------------------------- 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_maximal_segments(values):
    scores = np.array(values, float)
    found = toxicity.segments(scores)

    def brute(lo, hi):
        best = max(((scores[a:b].sum(), -(b - a)), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)) if hi > lo else None
        if best is None or best[0][0] <= 0:
            return []
        _, a, b = best
        return brute(lo, a) + [(a, b)] + brute(b, hi)

    assert sum(s for *_, s in found) == pytest.approx(sum(scores[a:b].sum() for a, b in brute(0, len(scores))))
    assert all(s == pytest.approx(scores[a:b].sum()) for a, b, s in found)


def test_training_texts_are_bounded_and_no_class_vanishes(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(4_000)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(4_000)] + [(5, 2), (None, 1)], "doc_id long, toxic int")
    sizes = {r["_y"]: r["count"] for r in toxicity.training_texts(docs, labels, F.lit(True), max_train=300).groupBy("_y").count().collect()}
    assert all(200 < n < 400 for n in sizes.values()) and set(sizes) == {0, 1}
    few = toxicity.training_texts(docs, labels, F.lit(True), max_train=401).groupBy("_y").count().collect()
    assert {r["_y"]: r["count"] for r in few}[1] == 400


def test_every_repeated_token_can_count(spark):
    """More kinds of tokens than the model once kept: each still gets its log-odds."""
    kinds = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(130_000)]
    rows = [(" ".join(kinds[j::13]), 0) for j in range(13)] * 2 + [(" ".join([*kinds[-40:], "vile"]), 1)] * 12
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "_text string, _y int").repartition(4))
    assert len(model.stems) > 100_000 and model.stems["vile"] > 0


def test_toxic_passages_are_learned(spark, documents):
    rng = random.Random(4)
    stems = ["vaqu", "lowd", "skum"]

    def text(bad):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(30, 200))]
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + "".join(rng.choice("xyz") for _ in range(rng.randrange(4))))
        return " ".join(words)

    marks = {i: int(rng.random() < 0.3) for i in range(600)}
    docs = documents([(i, text(y)) for i, y in marks.items()])
    labels = spark.createDataFrame([(i, y) for i, y in marks.items()], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(toxicity.training_texts(docs, labels, texts.remainder("_k", 4) != 2))
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    right = sum((scores[i] >= toxicity.THRESHOLD) == bool(marks[i]) for i in held)
    assert right / len(held) > 0.95
    kept = {r["doc_id"] for r in toxicity.keep_civil(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


# --------------------------------------------------------------------------- 9


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "LATER_RATE", 0.4)
    keys = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.pmod(F.hash("id"), F.lit(7)) == 0).alias("listed"))
    keys = materialised(keys)
    cascade = urlfilter.build_cascade(keys)
    assert len(cascade.levels) > 3
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_long_lists_are_split_into_cascades(spark, monkeypatch):
    """Above the old bound of one filter: parts by hash, no join, nulls and repeated rows kept."""
    keys = materialised(spark.range(6_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.pmod(F.hash("id"), F.lit(7)) == 0).alias("listed")))
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1 << 11)
    asked = keys.select("key", F.lit("clash").alias("_row")).unionByName(keys.limit(50).select("key", F.lit("again").alias("_row")))
    asked = asked.unionByName(spark.createDataFrame([(None, None)], "key string, _row string"))
    marked = urlfilter.mark_listed(asked, "key", keys, "found")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert marked.columns == ["key", "_row", "found"] and "Join" not in plan
    assert marked.count() == 6_051 and marked.where("key IS NULL AND NOT found").count() == 1
    assert marked.join(keys, "key").where("found <> listed").count() == 0
    rules = [urlfilter.Rule("block", f"host{i}.org", "/") for i in range(600)]
    pages = spark.createDataFrame([(i, f"http://www.host{i}.org/x") for i in range(590, 610)], "page_id long, url string")
    found = urlfilter.apply_rules(pages, rules).where("action = 'block'").count()
    assert found == 10
