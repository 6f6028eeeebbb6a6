"""The walk whose arcs are found beforehand against the one that looks every arc up."""

import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from duelframe.llm import lm


@pytest.fixture(scope="module")
def bucket():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = ["", "w1", "w1 w2", *[" ".join(rng.choices(words, range(60, 0, -1), k=rng.randrange(1, 80))) for _ in range(120)]]
    lists = [lm.tokens(t) for t in texts]
    flat = [w for x in lists for w in x]
    distinct = sorted(set(flat), key=lambda w: lm._hashes([w])[0])
    place = {w: i for i, w in enumerate(distinct)}
    ids = np.array([place[w] for w in flat], np.int32)
    packed = zlib.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
    m = lm._Bucket(lm._rising(lm._hashes(distinct)), packed, [len(x) for x in lists], [True] * len(lists))

    def answers(keys, times):
        return [cell for pdf in lm._counted(iter([lm._questions(0, keys, times, 1)])) for cell in pdf["x"]]

    m.hear_pairs(answers(*m.ask_pairs()))
    m.hear_triples(answers(*m.ask_triples()))
    m.find_failures()
    keys, sums = m.sums()
    question = pd.DataFrame({"shard": [0], "bucket": [0], "x": [lm._rising(keys)], "y": [lm._planes(sums.reshape(-1))], "wanted": [lm._rising(np.sort(m.wanted))]})
    return m, [next(lm._summed(iter([question])))["x"][0]], len(flat), len(distinct)


def test_arcs_found_beforehand_are_those_of_the_walk(bucket):
    m, told, total, types = bucket
    model = m.automaton(told, total, types)
    start = model.enter[m.end]
    looked_up = [model.walk(m.ids[i : i + n].tolist(), start) for i, n in zip(m.starts.tolist(), m.lengths.tolist())]
    found = m.scores(told, total, types)
    assert found["score"].tolist() == looked_up
    assert (m.n3 >= lm.FLOOR).any() and (m.n3 < lm.FLOOR).any() and (m.n2 < lm.FLOOR).any()


def test_arcs_are_not_looked_up_when_texts_are_scored(bucket, monkeypatch):
    """Looking up one arc after another was the longest step of a bucket."""
    m, told, total, types = bucket
    monkeypatch.setattr(lm.Automaton, "walk", None)
    assert np.isfinite(m.scores(told, total, types)["score"]).all()


@pytest.mark.parametrize("top", [10, 1 << 40, (1 << 63) - 1])
def test_distinct_values_of_any_size(top):
    """Small numbers share a word with their place, large ones do not."""
    values = np.random.default_rng(1).integers(0, top, 5_000, endpoint=True)
    values[::7] = values[0]
    found, place, which = lm._distinct(values)
    assert (np.diff(found) > 0).all() and (found[which] == values).all() and (values[place] == found).all()
    assert [len(x) for x in lm._distinct(values[:0])] == [0, 0, 0]


def test_a_shard_is_gone_when_the_next_is_read():
    """Its numbers stayed until the next shard was complete."""
    held = []

    def batches():
        for shard in range(4):
            held.append(tracemalloc.get_traced_memory()[0])
            keys = np.random.default_rng(shard).integers(1 << 40, 1 << 62, 100_000).astype(np.uint64)
            yield lm._questions(0, keys, np.ones(len(keys), np.int64), 1).assign(shard=shard)

    tracemalloc.start()
    try:
        told = sum(len(pdf) for pdf in lm._counted(batches()))
    finally:
        tracemalloc.stop()
    assert told == 4 and held[3] - held[1] < 400_000  # a cell of keys is 800,000 bytes


def test_tables_of_buckets_are_read_without_buffers_of_a_page(spark):
    """Buffers for whole pages of cells lie outside the heap and added up to hundreds of megabytes an executor."""
    with lm._Tables(spark) as tables:
        files = tables.store(spark.range(10).selectExpr("id AS bucket")).inputFiles()
        kinds = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in files}
    assert kinds == {"ZSTD"}
