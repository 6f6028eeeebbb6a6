"""Fill-in-the-middle transformation through piece tables.

A document is a list of descriptors over two immutable buffers, its text and the
sentinels. Cutting splits descriptors, an arrangement permutes them, the inverse
permutation restores the document, and texts and hashes stream over descriptors;
no step edits a text. Where to cut and how to arrange is decided by column
expressions from a hash of the key, so it does not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c
from duelframe.llm.texts import whole

#: Sentinels before prefix, suffix and middle, and the shares (percent) of the forms.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20

#: Order of the descriptors (three sentinels, prefix, middle, suffix) in either form.
ARRANGEMENTS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}

_BLOCK = 1 << 20


class Piece(NamedTuple):
    """``length`` bytes of a buffer from ``start`` on."""

    buffer: memoryview
    start: int
    length: int


def byte_offset(buffer: memoryview, position: int) -> int:
    """Byte at which code point ``position`` of UTF-8 starts; the end for the number of code points. Looks at a block at a time."""
    data = np.frombuffer(buffer, np.uint8)
    for at in range(0, len(data), _BLOCK):
        starts = (data[at : at + _BLOCK] & 0xC0) != 0x80
        n = int(np.count_nonzero(starts))
        if position < n:
            return at + int(np.flatnonzero(starts)[position])
        position -= n
    return len(data)


def cut(pieces: Sequence[Piece], at: int) -> list[Piece]:
    """Split the descriptor that holds byte ``at`` of the table; a cut at an edge leaves an empty descriptor."""
    out: list[Piece] = []
    for i, p in enumerate(pieces):
        if at <= p.length:
            return [*out, Piece(p.buffer, p.start, at), Piece(p.buffer, p.start + at, p.length - at), *pieces[i + 1 :]]
        out.append(p)
        at -= p.length
    raise ValueError("cut beyond the end of the table")


def arranged(pieces: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    return [pieces[i] for i in order]


def inverse(order: Sequence[int]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def stream(pieces: Iterable[Piece]) -> Iterable[memoryview]:
    return (p.buffer[p.start : p.start + p.length] for p in pieces if p.length)


def sha256(pieces: Iterable[Piece]) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces):
        digest.update(part)
    return digest.hexdigest()


def transformed(buffer: memoryview, form: str, prefix: int, middle: int, sentinels: Sequence[bytes]) -> list[Piece]:
    """Descriptors of the output of a text whose prefix and middle have that many code points."""
    text = [Piece(buffer, 0, len(buffer))]
    if form not in ARRANGEMENTS:
        return text
    first = byte_offset(buffer, prefix)
    second = first + byte_offset(buffer[first:], middle)
    text = cut(cut(text, second), first)
    return arranged([*(Piece(memoryview(s), 0, len(s)) for s in sentinels), *text], ARRANGEMENTS[form])


def restored(buffer: memoryview, form: str, sentinels: Sequence[bytes]) -> list[Piece]:
    """Descriptors of the text that was transformed into this output: cut at the sentinels, which occur once, and permuted back."""
    table = [Piece(buffer, 0, len(buffer))]
    if form not in ARRANGEMENTS:
        return table
    order, data, at = ARRANGEMENTS[form], bytes(buffer), 0
    for i in order:
        if i < len(sentinels):
            found = data.index(sentinels[i], at)
            at = found + len(sentinels[i])
            table = cut(cut(table, found), at)
    # The cut before the leading sentinel leaves an empty descriptor in front.
    return arranged(table[1:], inverse(order))[len(sentinels) :]


def _texts(parts: list[list[Piece]]) -> pa.Array:
    return pa.array([b"".join(stream(p)) for p in parts], pa.binary()).cast(pa.string())


def _checked(sentinels: Sequence[str]) -> list[bytes]:
    """Sentinels by which an output can be taken apart: no end of one is the start of one, so none can arise across a cut."""
    pairs = [(i, a, j, b) for i, a in enumerate(sentinels) for j, b in enumerate(sentinels)]
    joined = any(a.endswith(b[:k]) for i, a, j, b in pairs for k in range(1, len(b) + (i != j)))
    if joined or not all(sentinels) or any(a in b for i, a, j, b in pairs if i != j):
        raise ValueError("sentinels must not be empty, overlap or hold each other")
    return [s.encode() for s in sentinels]


def _drawn(key: Column, seed: int, group: int) -> Column:
    """Unsigned integer of the ``group``-th eight hexadecimal digits of the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """One row per row: ``key, n, form, prefix_chars, middle_chars, output, output_sha256``.

    ``form`` is ``plain`` (output is the text), ``psm`` or ``spm``. A text that is empty or
    holds a sentinel stays plain, as does a tenth of the others. Cuts count code points
    and are null for plain rows. A null text counts as empty, a null key as the empty
    text; repeated rows give repeated results; a text of any length is cut without being
    copied; other columns of ``docs`` are not looked at; an empty table gives an empty result.
    """
    marks = _checked(sentinels)

    @F.arrow_udf("struct<output: string, sha256: string>")
    def output(texts: pa.Array, forms: pa.Array, prefixes: pa.Array, middles: pa.Array) -> pa.Array:
        columns = zip(texts, forms.to_pylist(), prefixes.to_pylist(), middles.to_pylist())
        parts = [transformed(memoryview(t.as_buffer()), f, p, m, marks) for t, f, p, m in columns]
        return pa.StructArray.from_arrays([_texts(parts), pa.array([sha256(p) for p in parts], pa.string())], ["output", "sha256"])

    h = [_drawn(F.col("_key"), seed, i) for i in range(4)]
    rows = docs.select(c(key).alias("_key"), whole(text).alias("_text"))
    rows = rows.withColumn("n", F.char_length("_text").cast("long"))
    rows = rows.withColumns({"_a": h[0] % (F.col("n") + 1), "_b": h[1] % (F.col("n") + 1)})
    marked = F.lit(False)
    for s in sentinels:
        marked |= F.contains("_text", F.lit(s))
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= PLAIN_FROM)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm"))
    cut_only = F.col("form") != "plain"
    rows = rows.withColumns(
        {
            "prefix_chars": F.when(cut_only, F.least("_a", "_b")),
            "middle_chars": F.when(cut_only, F.greatest("_a", "_b") - F.least("_a", "_b")),
        }
    )
    done = rows.withColumn("_out", output("_text", "form", "prefix_chars", "middle_chars"))
    return done.select(
        F.col("_key").alias(key), "n", "form", "prefix_chars", "middle_chars",
        F.col("_out.output").alias("output"), F.col("_out.sha256").alias("output_sha256"),
    )


def restore(df: DataFrame, output: str = "output", form: str = "form", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``df`` with ``restored`` and ``restored_sha256``, rebuilt from ``output`` and ``form`` alone (columns of those names are replaced).

    A null output counts as empty and a null form as plain. A transformed output without
    its sentinels is an error.
    """
    marks = _checked(sentinels)

    @F.arrow_udf("struct<text: string, sha256: string>")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        parts = [restored(memoryview(o.as_buffer()), f, marks) for o, f in zip(outputs, forms.to_pylist())]
        return pa.StructArray.from_arrays([_texts(parts), pa.array([sha256(p) for p in parts], pa.string())], ["text", "sha256"])

    rows = df.select(*[c(n) for n in df.columns if n not in ("restored", "restored_sha256")], back(whole(output), c(form)).alias("_back"))
    return rows.select(
        *[c(n) for n in rows.columns if n != "_back"], F.col("_back.text").alias("restored"), F.col("_back.sha256").alias("restored_sha256")
    )
