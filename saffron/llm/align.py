"""Alignment of two tokenizers by a dangling-suffix transducer.

Both encode the same bytes. The transducer reads tokens of either side and holds
which side leads and the bytes by which it does; the side behind gives the next
token. Where the residual is empty both sides end at one byte and a group of tokens
closes. Transitions are memoised by residual and next token, in each worker; of the
empty residual, where most groups are one token of either side, by both tokens at once.

All occurrence pairs inside a group are links. A document gives its different id
pairs with how often each is linked; counts of documents for every pair are one
aggregation over them, and each document's links look their counts up again. Hot
pairs are broadcast, the others joined by shuffling.

Defined results: null and empty texts, and texts that the two sides spell
differently (a literal U+2581, for instance), have no tokens: zeros and no groups;
repeated rows repeat and count as documents of their own; a null id stays null; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .durable import durable
from .skew import join_groups

#: Transitions, and pairs of first tokens, that a worker keeps; links of a group that are counted one by one.
MEMO, FIRSTS, FEW = 1 << 18, 1 << 18, 64
#: Id pairs (20 bytes each) up to which their table is broadcast; beyond, only frequent ones are.
BROADCAST_PAIRS = 400_000
#: Bits of a B id in the number of an id pair.
SHIFT = 20


def byte_side(path: str, pattern: str) -> tuple:
    """(encode, bytes of each id) of a byte-level file whose merges come in the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    merged = [ranks[bytes(byte_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in pairwise(merged)):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, {i: b for b, i in ranks.items()}


def piece_side(path: str) -> tuple:
    """(encode, bytes of each id) of a sentence-piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.vocab_size()) for p in [model.id_to_piece(i)]}
    return lambda text: model.encode(text, num_threads=1), pieces


class Transducer:
    """Groups of tokens of two sides that spell the same bytes.

    States are (side that leads, residual); the empty residual is state 0. Odd
    states wait for a token of A, even ones above 0 for one of B.
    """

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> None:
        self.bytes = (a_bytes, b_bytes)
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[int, int] = {}
        self.state: dict[tuple[int, bytes], int] = {}
        self.held: dict[int, bytes] = {0: b""}
        self.firsts: dict[int, str] = {}

    def _number(self, leader: int, residual: bytes) -> int:
        if not residual:
            return 0
        n = self.state.setdefault((leader, residual), 2 * (len(self.state) + 1) + leader)
        self.held[n] = residual
        return n

    def _step(self, state: int, token: int) -> int:
        """The next state; a token of A is read in odd states and in 0."""
        reader = 0 if state & 1 or not state else 1
        residual, new = self.held[state], self.bytes[reader][token]
        if len(new) <= len(residual):
            if not residual.startswith(new):
                raise ValueError("the sides spell different bytes")
            return self._number(1 - reader, residual[len(new) :])
        if not new.startswith(residual):
            raise ValueError("the sides spell different bytes")
        return self._number(reader, new[len(residual) :])

    def _group(self, a: list[int], b: list[int], i: int, j: int) -> tuple[int, int]:
        """Where the group that opens at token ``i`` of A and ``j`` of B closes."""
        get, memo, state = self.memo.get, self.memo, 0
        while True:
            if not state or state & 1:
                key = state << SHIFT | a[i]
                i += 1
            else:
                key = state << SHIFT | b[j]
                j += 1
            state = get(key)
            if state is None:
                state = memo[key] = self._step(key >> SHIFT, key & (1 << SHIFT) - 1)
            if not state:
                return i, j

    def groups(self, a: list[int], b: list[int]) -> tuple[list[str], list[int], list[tuple[list[int], list[int]]]]:
        """Each group as ``a1,a2|b1,b2`` (decimal ids), the id pairs (a << SHIFT | b) of all links, and groups of over FEW links apart."""
        if len(self.memo) > MEMO or len(self.firsts) > FIRSTS:
            self._clear()
        out: list[str] = []
        pairs: list[int] = []
        long: list[tuple[list[int], list[int]]] = []
        firsts, get, say, link = self.firsts, self.firsts.get, out.append, pairs.append
        i = j = 0
        n = len(a)
        while i < n:
            pair = a[i] << SHIFT | b[j]
            said = get(pair)
            if said is None:
                said = firsts[pair] = f"{a[i]}|{b[j]}" if self.bytes[0][a[i]] == self.bytes[1][b[j]] else ""
            if said:
                say(said)
                link(pair)
                i += 1
                j += 1
                continue
            k, m = self._group(a, b, i, j)
            x, y = a[i:k], b[j:m]
            say(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            if len(x) * len(y) > FEW:
                long.append((x, y))
            else:
                pairs += [v << SHIFT | w for v in x for w in y]
            i, j = k, m
        return out, pairs, long


class Aligner:
    def __init__(self, a_path: str, a_pattern: str, b_path: str) -> None:
        self.encode_a, self.a_bytes = byte_side(a_path, a_pattern)
        self.encode_b, self.b_bytes = piece_side(b_path)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B of space + text; none where they don't spell it alike."""
        if not text:
            return [], []
        b = self.encode_b(text)
        if b"".join([self.b_bytes[x] for x in b]) != (" " + text).encode():  # A spells any text
            return [], []
        return self.encode_a(" " + text), b

    def measure(self, text: str | None) -> tuple[int, int, int, int, str, dict[int, int]]:
        """Numbers of tokens, groups and links, the groups as text, and the links of each id pair."""
        a, b = self.tokens(text)
        groups, pairs, long = self.transducer.groups(a, b)
        links, count = len(pairs), Counter(pairs)
        for x, y in long:  # by different ids, of which a long group has few
            links += len(x) * len(y)
            for v, s in Counter(x).items():
                for w, t in Counter(y).items():
                    count[v << SHIFT | w] += s * t
        return len(a), len(b), len(groups), links, ";".join(groups), count


def default_paths() -> tuple[str, str, str]:
    """Vocabulary and pattern of A, and model of B, on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@cache
def aligner(a_path: str | None = None, a_pattern: str | None = None, b_path: str | None = None) -> Aligner:
    """One aligner for each pair of files and worker."""
    own = (None, None, None) if a_path and a_pattern and b_path else default_paths()
    return Aligner(a_path or own[0], a_pattern or own[1], b_path or own[2])


def spans(spelled: str, own: Aligner) -> list[dict]:
    """The groups of a text as ids, each with the byte at which it ends."""
    out, stop = [], 0
    for group in spelled.split(";") if spelled else []:
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        stop += sum(len(own.a_bytes[x]) for x in a)
        out.append({"a": a, "b": b, "stop": stop})
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
GROUPS = "array<struct<a: array<int>, b: array<int>, stop: long>>"


def aligned(documents: DataFrame, a_path: str | None = None, a_pattern: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Groups of each whole text by their digest and linked id pairs; with ``groups`` also the groups, each with the byte at which it ends."""
    schema = f"{ALIGNED}, groups {GROUPS}" if groups else ALIGNED
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, a_pattern, b_path)
        for batch in batches:
            cells: list[list] = [[] for _ in range(7 + groups)]
            for text in batch.column(1):
                *numbers, spelled, pairs = own.measure(text.as_py())
                row = [*numbers, hashlib.sha256(spelled.encode()).hexdigest() if spelled else "", list(pairs), list(pairs.values())]
                if groups:
                    row.append(spans(spelled, own))
                for cell, value in zip(cells, row, strict=True):
                    cell.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 2, kind]
            arrays = [pa.array(c, k) for c, k in zip(cells, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[x.split()[0] for x in ALIGNED.split(", ")] + ["groups"] * groups)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold an id pair linked, and whether no other pair of its A id is held by more."""
    counts = durable(links.groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pair-counts")
    # One A id has at most as many pairs as B has ids.
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return durable(counts.withColumn("best", F.col("count") == most), "best-pairs")


def alignment(documents: DataFrame, a_path: str | None = None, a_pattern: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    rows = durable(aligned(documents, a_path, a_pattern, b_path, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_link")).select("_row", F.col("_link.pairs").alias("pair"), F.col("_link.times").alias("times"))
    counts = pair_counts(rows.select(F.explode("pairs").alias("pair")))
    if counts.count() <= BROADCAST_PAIRS:
        known = links.join(F.broadcast(counts), "pair")
    else:
        known = join_groups(links, counts, "pair", "count", counts.agg(F.sum("count")).first()[0])
    sums = known.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    whole = rows.drop("pairs", "times").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
