"""Piece tables against plain slicing of texts, and the exact way back."""

import hashlib

import pytest
from hypothesis import given, strategies as st

from duelframe.llm import fim

MARKS = [s.encode() for s in fim.SENTINELS]


def view(text):
    return memoryview(text.encode())


def plain_version(key, text):
    """(n, form, prefix, middle, output) by slicing."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text, n = text or "", len(text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@given(st.text(alphabet="aé日\U0001f600<>PSM\x00\n", max_size=40), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_round_trip_of_any_cut(text, x, y, form):
    if any(s in text for s in fim.SENTINELS):
        return
    a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
    output = b"".join(fim.stream(fim.transformed(view(text), form, a, b - a, MARKS)))
    ends = {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>"}
    assert output.decode() == ends[form] + text[a:b]
    table = fim.restored(memoryview(output), form, MARKS)
    assert b"".join(fim.stream(table)).decode() == text
    assert fim.sha256(table) == hashlib.sha256(text.encode()).hexdigest()


def test_piece_tables():
    data = memoryview(b"abcdef")
    table = fim.cut(fim.cut([fim.Piece(data, 0, 6)], 4), 1)
    assert [(p.start, p.length) for p in table] == [(0, 1), (1, 3), (4, 2)]
    assert [(p.start, p.length) for p in fim.cut(table, 0)[:2]] == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        fim.cut(table, 7)
    order = (2, 0, 1)
    assert fim.arranged(fim.arranged(table, order), fim.inverse(order)) == table


def test_offsets_across_blocks(monkeypatch):
    monkeypatch.setattr(fim, "_BLOCK", 5)
    text = "aé日\U0001f600z" * 7
    assert [fim.byte_offset(view(text), i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert fim.byte_offset(view(""), 0) == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d"), ("", "b", "c")])
def test_sentinels_that_cannot_be_told_apart(marks):
    with pytest.raises(ValueError):
        fim._checked(marks)


def test_messy_rows(documents, messy):
    odd = [(20 + i, f"text {i} \U0001f600 with some é words") for i in range(60)]
    odd += [(90, "has <P> inside"), (91, "<M>"), (92, "almost <P <S< M>"), (93, "x"), (94, "a\x00b\r\n"), (2**62, "long key")]
    rows = messy + odd
    found = fim.restore(fim.fill_in_middle(documents(rows))).collect()

    def row(key, text):
        n, form, a, m, output = plain_version(key, text)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (output, text or "")]
        return key, n, form, a, m, output, digests[0], text or "", digests[1]

    assert sorted(map(tuple, found), key=str) == sorted((row(*r) for r in rows), key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_nulls(spark, documents):
    assert fim.restore(fim.fill_in_middle(documents([]))).collect() == []
    rows = spark.createDataFrame([(None, None), ("<P>a<S>c<M>b", "psm")], "output string, form string")
    assert [r["restored"] for r in fim.restore(rows).collect()] == ["", "abc"]
