"""Fill-in-middle transformation by a parallel automaton scan.

A text's units are runs of letters A-Z, a-z and single other code points. The
automaton that reads them has two states, between units and inside a run. A chunk
of text gives its state-transition function and, for each entry state, how many
units start in it; such summaries compose associatively, so the entry state and the
first unit of every chunk follow without reading the text in order. Texts up to
GIANT code points are one chunk and stay where they are. Longer ones are dealt out as
chunks over the cluster: summaries first, then only the chunks in which a cut
falls are read again for its place.

Defined results: a null text counts as empty, a null id as empty text in the draws;
repeated rows repeat, the same id and text always give the same output; other columns
are left out; an empty table gives no rows. An output holds its whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .skew import join_groups

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Code points of a chunk, and of the longest text that is read as one.
CHUNK, GIANT = 1 << 14, 1 << 16
#: Of a hundred documents: those transformed, and of these the ones that start with their suffix.
SHARE, SUFFIX_FIRST = 90, 20
#: Units that start at a letter (1) or another code point (0), entered between units (0) or inside a run (1).
STARTS = ((1, 1), (1, 0))


class Summary(NamedTuple):
    """What a chunk does to the automaton: for either entry state, the state it leaves and the units it starts."""

    after: tuple[int, int] = (0, 1)
    starts: tuple[int, int] = (0, 0)

    def then(self, other: Summary) -> Summary:
        after, starts = zip(*((other.after[s], n + other.starts[s]) for s, n in zip(self.after, self.starts, strict=True)), strict=True)
        return Summary(after, starts)


def letters(text: str) -> np.ndarray:
    """Which code points are letters A-Z, a-z."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (codes | 32) - 97 < 26  # unsigned: smaller codes wrap around


def summary(letter: np.ndarray) -> Summary:
    if not len(letter):
        return Summary()
    inner, last = int(np.count_nonzero(~(letter[1:] & letter[:-1]))), int(letter[-1])
    return Summary((last, last), tuple(inner + STARTS[s][int(letter[0])] for s in (0, 1)))


def place(letter: np.ndarray, entry: int, nth: int) -> int:
    """Where in a chunk its ``nth`` unit starts (from 0); its length if it has no such unit."""
    begins = np.ones(len(letter), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    begins[:1] = STARTS[entry][int(letter[0])] if len(letter) else False
    at = np.flatnonzero(begins)
    return int(at[nth]) if nth < len(at) else len(letter)


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits, the same for the same id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def form_of(doc_id: int | None, text: str) -> str:
    h = draws(doc_id)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= SHARE:
        return "plain"
    return "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"


def cuts(doc_id: int | None, n: int) -> tuple[int, int]:
    """After how many of ``n`` units the prefix and the middle end."""
    a, b = (h % (n + 1) for h in draws(doc_id)[:2])
    return min(a, b), max(a, b)


def render(text: str, form: str, a: int, b: int) -> str:
    """The output of a text cut at the code points ``a`` and ``b``."""
    if form == "plain":
        return text
    parts = (PREFIX, text[:a], SUFFIX, text[b:]) if form == "psm" else (SUFFIX, text[b:], PREFIX, text[:a])
    return "".join((*parts, MIDDLE, text[a:b]))


def restored(output: Column, form: Column) -> Column:
    """The text, from its output and form; it holds none of the marks, so each mark stands once."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    body = F.substr(head, F.lit(len(PREFIX) + 1))
    left, right = F.call_function("substring_index", body, second, F.lit(1)), F.call_function("substring_index", body, second, F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _filled(doc_id: int | None, text: str, n: int, a: int, b: int) -> tuple:
    form = form_of(doc_id, text)
    sizes = (None, None) if form == "plain" else (a, b - a)
    return doc_id, n, form, *sizes, render(text, form, a, b)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one chunk."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            letter = letters(text)
            n = summary(letter).starts[0]
            rows.append(_filled(doc_id, text, n, *(place(letter, 0, k) for k in cuts(doc_id, n))))
        yield _batch(rows, FILLED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [(key, doc_id, i // CHUNK, text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64], CHUNKED)


CHUNKED = "key string, doc_id long, part long, chars string"
SUMMED = "key string, doc_id long, part long, length long, after0 int, after1 int, starts0 long, starts1 long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, doc_id, part, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = summary(letters(chars))
            rows.append((key, doc_id, part, len(chars), *s.after, *s.starts))
        yield _batch(rows, SUMMED)


WANTED = "key string, units long, cut int, part long, entry int, nth long"


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """Units of one text, and the chunk, entry state and unit of either cut; of its chunks only summaries come here."""
    rows = rows.sort_values("part")
    parts = [Summary((a, b), (c, d)) for a, b, c, d in zip(rows.after0, rows.after1, rows.starts0, rows.starts1, strict=True)]
    key, doc_id = rows.key.iloc[0], None if pd.isna(rows.doc_id.iloc[0]) else int(rows.doc_id.iloc[0])
    n = reduce(Summary.then, parts, Summary()).starts[0]
    out = []
    for cut, wanted in enumerate(cuts(doc_id, n)):
        before = Summary()
        for part, s in enumerate(parts):
            after = before.then(s)
            if wanted < after.starts[0] or part == len(parts) - 1:
                out.append((key, n, cut, part, before.after[0], wanted - before.starts[0]))
                break
            before = after
    return pd.DataFrame(out, columns=[x.split()[0] for x in WANTED.split(", ")])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, units, cut, part, entry, nth, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((key, units, cut, part * CHUNK + place(letters(chars), entry, nth)))
        yield _batch(rows, PLACED)


PLACED = "key string, units long, cut int, at long"


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _batch([_filled(*row)], FILLED)


def _giants(giants: DataFrame) -> DataFrame:
    """FILLED of texts of many chunks. Equal ids and texts share a key and are scanned once."""
    own = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"), 256)
    keyed = durable(giants.select(own.alias("key"), "doc_id", "text"), "giants")
    once = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    chunks = durable(once.mapInArrow(_chunks, CHUNKED).repartition("key", "part"), "chunks")
    wanted = durable(chunks.mapInArrow(_summaries, SUMMED).groupBy("key").applyInPandas(_compose, WANTED), "cuts")
    found = wanted.join(chunks.select("key", "part", "chars"), ["key", "part"]).select(*(x.split()[0] for x in WANTED.split(", ")), "chars").mapInArrow(_places, PLACED)
    at = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("at")))
    placed = found.groupBy("key").agg(F.first("units").alias("units"), at(0).alias("a"), at(1).alias("b"))
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    placed = durable(placed.join(copies, "key"), "placed")
    return join_groups(keyed, placed, "key", "copies", keyed.count()).select("doc_id", "text", "units", "a", "b").mapInArrow(_rendered, FILLED)


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each whole text.

    ``n`` counts units; the cuts, the form and so the output depend on id and text only.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.char_length("text") > GIANT
    filled = texts.where(~long).mapInArrow(_whole, FILLED)
    giants = durable(texts.where(long), "long-texts")
    return filled if giants.isEmpty() else filled.unionByName(_giants(giants))


def infill_digests(filled: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
