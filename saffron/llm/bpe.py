"""Byte-level BPE encoding and decoding with a public vocabulary file.

A short word is held as a contiguous list of part boundaries with the ranks of
adjacent pairs: the smallest rank is looked up, its boundary deleted and the two
neighbouring ranks refreshed. Words beyond SHORT bytes keep the same order of
merges in a heap over a linked list, so their cost stays near linear.

Defined results: a null text counts as empty and has no tokens; the file's added
tokens are matched before splitting, as the file asks; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
#: Words whose encoding a worker keeps, in each of two generations.
CACHED = 120_000
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.first = [vocab[bytes([b])] for b in range(256)]
        # (left id, right id) as one integer -> rank and merged id as one integer
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.pairs.setdefault(vocab[left] << 20 | vocab[right], rank << 20 | vocab[left + right])
        self.bytes = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.split = regex.compile(pattern)
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.first[b] for b in word]
        return self._merge_long(ids) if len(ids) > SHORT else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue  # a part has changed since
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _missing(self, word: str) -> bytes:
        """Ids of a word that the young generation lacks, as little-endian 32-bit."""
        got = self.old.get(word)
        if got is None:
            got = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= SHORT:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        words = self.split.findall(text)
        young = self.young
        out = list(map(young.get, words))
        at = -1
        try:
            while True:
                at = out.index(None, at + 1)
                out[at] = self._missing(words[at])
        except ValueError:
            return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.specials or not (found := list(self.specials.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [self._plain(text[at : m.start()]), array("I", [self.added[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, array("I", ids))).decode("utf-8", errors="replace")


def default_vocabulary() -> tuple[str, str]:
    """Path of the 50k byte-level vocabulary on this machine, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@cache
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """One codec for each vocabulary and worker; without a path, this machine's own 50k file."""
    own = (None, None) if path and pattern else default_vocabulary()
    return Codec(path or own[0], pattern or own[1])


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Token counts and digests of each whole text; with ``ids`` also the ids themselves."""
    schema = CODED + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            coded = [c.encode(x.as_py()) for x in b.column(1)]
            cells = [
                b.column(0),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in coded], pa.string()),
            ]
            if ids:
                cells.append(pa.array([list(array("i", x)) for x in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cells, names=names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [None if (x := v.as_py()) is None else c.decode(array("I", x).tobytes()) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
