"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of distinct word shingles. Its signature holds HASHES
b-bit minimum hashes. Signatures are split into CHUNKS chunks; if two differ in
at most THRESHOLD hashes, then by the pigeonhole principle some chunk has at
most one error, so indexing every chunk with each one hash left out finds all
pairs under the threshold. Two sets of the Jaccard similarity asked for exceed
the threshold with a chance of about 3 in 10,000, so links are missed that rarely.

Identical sets first become one class. In each index bucket the best connected
class is the hub; every class is confirmed on full sets against the hub with
which it shares most buckets. Classes of one hub are a family, and what tells a
class from its hub (its delta) is kept: two sets differ in exactly those hashes
in which their deltas differ, so a family's other links follow from deltas, block
by block, without texts and without a row for each pair. Buckets that still join
different components of different families are then searched for pairs under the
threshold: first the nearest ones of each class, then all. In families and buckets
only what stands apart from the hub or the main component is compared with the rest.

Defined results: null or empty texts have an empty set and no links; a null
doc_id has no links and a null component; copies of a row share its class. Where one
doc_id stands on rows of different texts, each row belongs to the group of its own
text; two groups may then have the same smallest id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import durable
from .fuse import mix
from .idfilter import id_filter, without_ids
from .skew import join_groups

CHUNKS, CHUNK = 12, 5
HASHES = CHUNKS * CHUNK
#: With one error allowed in each chunk, this many differing hashes leave a chunk with one at most.
THRESHOLD = 2 * CHUNKS - 1
#: Partners that the first search of mixed buckets offers to each class.
NEAREST = 8
#: A class belongs to its hub's family from this percentage of similarity on.
KIN = 50
#: Classes of a family, or of a mixed bucket, that one task compares with as many others.
FAMILY_BLOCK, BUCKET_BLOCK = 128, 4096
#: Hashes counted at a time, and bytes whose words are hashed at a time.
HASH_BLOCK, PIECE = 4096, 1 << 17

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TIMES = _rng.integers(0, 1 << 63, HASHES, dtype=_U) * _U(2) + _U(1)
_PLUS = _rng.integers(0, 1 << 63, HASHES, dtype=_U)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in pieces of about PIECE, cut where white space begins."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            space = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            if len(space):
                end += int(space[0])
                break
            end = min(len(raw), end + 4096)
        yield raw[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    found = [_word_hashes(x) for x in _pieces(np.frombuffer(text.encode(), np.uint8))]
    return np.concatenate(found) if found else np.zeros(0, _U)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    raw = _LOWER[raw]
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    if not len(edge):
        return np.zeros(0, _U)
    lengths = edge[1::2] - edge[::2]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    values = (raw[word].astype(_U) + _U(1)) * powers[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(_U), 1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words; of all words, if they are fewer."""
    h = word_hashes(text or "")
    k = min(words, len(h))
    if not k:
        return h
    run = np.zeros(len(h) - k + 1, _U)
    for i in range(k):
        run = mix(run * _BASE + h[i : len(h) - k + 1 + i], 2)
    return np.unique(run)


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash."""
    least = np.full(HASHES, np.iinfo(_U).max, _U)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (mix(least, 3) >> _U(48)).astype(np.uint16)


def signatures(documents: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sig) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sigs = [], [], []
            for x in b.column(2):
                found = shingles(x.as_py(), words)
                sizes.append(len(found))
                digests.append(set_digest(found))
                sigs.append(signature(found).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): the chunks of each signature, each with one hash left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sig = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(_U)
                keys = []
                for left_out in range(CHUNK):
                    packed = np.zeros(sig.shape[:2], _U)
                    for i in range(CHUNK):
                        if i != left_out:
                            packed = (packed << _U(16)) | sig[:, :, i]
                    keys.append(mix(packed, 0) + mix(np.arange(CHUNKS, dtype=_U) * _U(CHUNK) + _U(left_out), 5))
                flat = np.stack(keys, axis=2).reshape(part.num_rows, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), HASHES), pa.int64())], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


PAIR = "a long, b long, linked boolean, size_a long, delta binary"


def _judged(documents: DataFrame, total: int, pairs: DataFrame, classes: DataFrame, repeated: bool, words: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """Each pair (a, b) judged on full sets: linked if 100 * intersection >= share * union.

    Pairs of at least KIN percent also get the hashes that only one of the sets has.
    Only texts that may be in a pair move; a hub's many partners are dealt by Spark's
    splitting of skewed joins, and the hub's set is kept while its partners follow.
    ``repeated`` says that some id stands on several rows, perhaps of different texts:
    then a class is known by one text of its id, and of an id's rows each text counts once.
    """
    if repeated:
        known = durable(classes.select("cls", "doc", "text_hash", "digest"), "known")
        pairs = pairs.join(known.toDF("a", "id_a", "hash_a", "digest_a"), "a").join(known.toDF("b", "id_b", "hash_b", "digest_b"), "b")
    else:
        pairs = pairs.withColumns({"id_a": F.col("a"), "id_b": F.col("b")} | {c: F.lit(None).cast("binary") for c in ("digest_a", "digest_b")})
    ids = durable(pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct(), "ids")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    maybe = id_filter(ids, "id", ids.count(), total)
    texts = texts if maybe is None else texts.where(maybe("id"))
    key = ["id", "hash"] if repeated else ["id"]
    if repeated:
        wanted = durable(known.select(F.col("doc").alias("id"), F.col("text_hash").alias("hash")).join(ids, "id", "left_semi"), "wanted")
        texts = texts.withColumn("hash", F.xxhash64("text")).groupBy(*key).agg(F.first("text").alias("text")).join(wanted, key, "left_semi")
        texts = durable(texts, "texts")
    side = lambda s: texts.select(*(F.col(k).alias(f"{k}_{s}") for k in key), F.col("text").alias(f"text_{s}"))
    one = pairs.join(side("a"), [f"{k}_a" for k in key])
    both = one.join(side("b"), [f"{k}_b" for k in key]).select("a", "b", "digest_a", "digest_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray, bytes] | None = None
        for batch in batches:
            out: list[tuple] = []
            a, b, da, db, ta, tb = batch.columns
            for i in range(batch.num_rows):
                text = tb[i].as_py()
                if last is None or last[0] != text:
                    found = shingles(text, words)
                    last = text, found, set_digest(found)
                mine = shingles(ta[i].as_py(), words)
                # A text that merely shares the hash of the class's own is none of it.
                if repeated and (last[2] != db[i].as_py() or set_digest(mine) != da[i].as_py()):
                    continue
                delta = np.setxor1d(mine, last[1], assume_unique=True)
                union = (len(mine) + len(last[1]) + len(delta)) // 2
                common = union - len(delta)
                out.append((a[i].as_py(), b[i].as_py(), 100 * common >= share * union, len(mine), delta.tobytes() if 100 * common >= KIN * union else None))
            cells = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["a", "b", "linked", "size_a", "delta"])

    return both.mapInArrow(run, PAIR)


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches that are sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        new = np.zeros(t.num_rows - 1, bool)
        for k in key:
            column = t[k].to_numpy()
            new |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1)]
        for start, stop in zip(cuts, cuts[1:]):  # noqa: B905
            yield t.slice(start, stop - start)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held


def _spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of links between places, enough to connect what they connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _dealt(rows: DataFrame, key: str, size: str, others: str, member: str, block: int) -> DataFrame:
    """Units of work (key, left, right) that compare each ``apart`` row of a group with all its rows.

    ``size`` counts a group's rows and ``others`` those that are apart; the rest need no
    comparison with each other, so rows are repeated for the apart ones only. Each block
    of apart rows meets each block of all rows in one unit of at most about 2 * ``block``
    rows; ``asks`` and ``answers`` tell the parts of a row in its unit.
    """
    lefts, rights = (F.ceil(F.col(c) / block).cast("int") for c in (others, size))
    mine = F.pmod(F.xxhash64(member), rights).cast("int")
    asking = F.pmod(F.xxhash64(member, F.lit(1)), lefts).cast("int")
    unit = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    held = F.transform(F.sequence(F.lit(0), lefts - 1), lambda left: unit(left, mine))
    asked = F.transform(F.filter(F.sequence(F.lit(0), rights - 1), lambda right: right != mine), lambda right: unit(asking, right))
    units = F.when(F.col("apart"), F.concat(held, asked)).otherwise(held)
    dealt = rows.withColumns({"_unit": F.explode(units)})
    kept = [c for c in rows.columns if c not in (size, others)]
    left, right = F.col("_unit.left"), F.col("_unit.right")
    dealt = dealt.select(*kept, left.alias("left"), right.alias("right"), (F.col("apart") & (asking == left)).alias("asks"), (mine == right).alias("answers"))
    return dealt.repartition(key, "left", "right").sortWithinPartitions(key, "left", "right")


def _family_links(stars: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between the classes of a family of which one isn't linked with the hub.

    A class that is linked with the hub needs no link with others that are, so each
    class apart from the hub is compared with the whole family, block by block.
    """
    kin = stars.where("delta is not null")
    sizes = kin.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("linked"), 1)).alias("others")).where("n > 1 and others > 0")
    rows = join_groups(kin, sizes.select("b", "n", "others"), "b", "n", stars.count())
    rows = rows.select("b", "a", "size_a", "delta", (~F.col("linked")).alias("apart"), "n", "others")

    def links(t: pa.Table) -> list[tuple[int, int]]:
        ids, size, asks, answers = (t[c].to_numpy() for c in ("a", "size_a", "asks", "answers"))
        deltas = [np.frombuffer(x.as_py(), _U) for x in t["delta"]]
        length = np.array([len(x) for x in deltas])
        left, right = np.flatnonzero(asks), np.flatnonzero(answers)
        _, place, times = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), length)
        shared = times[place] > 1
        column = (np.cumsum(times > 1) - 1)[place[shared]]
        row = row[shared]
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int((times > 1).sum()), HASH_BLOCK):
            lo, hi = np.searchsorted(column, [at, at + HASH_BLOCK])
            held = np.zeros((len(ids), HASH_BLOCK), np.float32)
            held[row[lo:hi], column[lo:hi] - at] = 1
            common += held[left] @ held[right].T
        apart = length[left][:, None] + length[right][None, :] - 2 * common
        near = apart * (100 + share) <= (100 - share) * (size[left][:, None] + size[right][None, :])
        near &= left[:, None] != right[None, :]
        x, y = np.nonzero(near)
        return [(int(ids[i]), int(ids[j])) for i, j in _spanning(left[x], right[y])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["b", "left", "right"]):
            out = links(t) if t.num_rows > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return _dealt(rows, "b", "n", "others", "a", FAMILY_BLOCK).mapInArrow(run, "a long, b long")


def _mixed_pairs(rows: DataFrame, share: int, nearest: int | None) -> DataFrame:
    """Pairs under the signature threshold, in one bucket but in different components and families.

    ``rows`` holds (key, size, others, cls, comp, family, n_shingles, sig, apart). Pairs whose
    sizes rule the similarity out are left out; ``nearest`` keeps each class's nearest
    partners. Classes of a bucket's most frequent component need no partners of it, so
    each class apart from it is compared with the whole bucket, block by block. A row
    (key, null) tells a bucket of which ``nearest`` left partners out.
    """

    def search(t: pa.Table) -> tuple[np.ndarray, bool]:
        cls, comp, family, size, asks, answers = (t[c].to_numpy() for c in ("cls", "comp", "family", "n_shingles", "asks", "answers"))
        sig = np.frombuffer(b"".join(x.as_py() for x in t["sig"]), np.uint16).reshape(-1, HASHES)
        right = np.flatnonzero(answers)
        out, left_out = [], False
        for i in np.flatnonzero(asks):
            near = (comp[right] != comp[i]) & (family[right] != family[i]) & (100 * np.minimum(size[right], size[i]) >= share * np.maximum(size[right], size[i]))
            at = right[near]
            if len(at):
                apart = (sig[at] != sig[i]).sum(axis=1)
                at, apart = at[apart <= THRESHOLD], apart[apart <= THRESHOLD]
                if nearest and len(at) > nearest:
                    at, left_out = at[np.argsort(apart, kind="stable")[:nearest]], True
                out.append(np.stack([np.minimum(cls[at], cls[i]), np.maximum(cls[at], cls[i])], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), left_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "left", "right"]):
            found, left_out = search(t)
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])
            if left_out:
                yield pa.RecordBatch.from_arrays([t["key"].combine_chunks()[:1], pa.array([None], pa.int64())], names=["a", "b"])

    return _dealt(rows, "key", "size", "others", "cls", BUCKET_BLOCK).mapInArrow(run, "a long, b long").distinct()


def _mixed_buckets(hits: DataFrame, classes: DataFrame, labels: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component and family."""
    family = stars.where("delta is not null").select(F.col("a").alias("cls"), F.col("b").alias("family"))
    own = classes.select("cls", "n_shingles", "sig").join(labels.withColumnRenamed("id", "cls"), "cls", "left").join(family, "cls", "left")
    own = durable(own.withColumns({"comp": F.coalesce("comp", "cls"), "family": F.coalesce("family", "cls")}), "members")
    rows = hits.join(own.select("cls", "comp", "family"), "cls")
    comps = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("low"), F.max("family").alias("high"))
    most = F.max(F.struct("n", "comp"))
    mixed = comps.groupBy("key").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), (F.min("low") != F.max("high")).alias("families"), most["comp"].alias("main"), (F.sum("n") - most["n"]).alias("others"))
    mixed = mixed.where("comps > 1 and families").select("key", "size", "others", "main")
    found = rows.join(mixed, "key").join(own.select("cls", "n_shingles", "sig"), "cls")
    return found.select("key", "size", "others", "cls", "comp", "family", "n_shingles", "sig", (F.col("comp") != F.col("main")).alias("apart"))


def _banded(found: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """(key, cls) of ``found`` (key, cls, size), its large buckets parted by the sizes of sets.

    Sets of ``share`` percent similarity differ in size by that factor at most, so they
    stand in one band of sizes or in neighbouring ones; each row of a large bucket goes
    into its band and the next, and a pair still meets wherever it can be linked.
    """
    large = found.where(F.col("size") > BUCKET_BLOCK)
    if large.isEmpty():
        return found.select("key", "cls")
    width = math.log(100 / share) * (1 + 1e-9) if share < 100 else 1e-9
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("long")
    parted = large.join(classes.select("cls", "n_shingles"), "cls").withColumn("_band", F.explode(F.array(band, band + 1)))
    return durable(found.where(F.col("size") <= BUCKET_BLOCK).select("key", "cls").unionByName(parted.select(F.xxhash64("key", "_band").alias("key"), "cls")), "banded")


def _groups(documents: DataFrame, words: int, share: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, n_shingles, digest, component_id, kept) of each row, and whether some id stands on several rows."""
    rows = durable(signatures(documents, words, id_col, text_col), "signatures")
    total = rows.count()
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    repeated = not linked.groupBy("doc_id").count().where("count > 1").isEmpty()
    # A class is named by its smallest id; by its digest where an id may have several sets.
    name = F.xxhash64("digest") if repeated else F.col("doc")
    classes = durable(linked.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")).select("*", "own.text_hash", F.col("own.doc_id").alias("doc")).withColumn("cls", name).drop("own"), "classes")
    keys = durable(index_keys(classes), "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    hit_sizes = durable(keys.join(buckets, "key"), "hits")
    degree = hit_sizes.groupBy("cls").agg(F.sum("size").alias("degree"))
    ranked = durable(hit_sizes.select("key", "cls").join(degree, "cls"), "ranked")
    hub = durable(ranked.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("fewer"), "cls"))["cls"].alias("hub"), F.count(F.lit(1)).alias("size")), "hubs")
    hits = ranked.select("key", "cls")
    shared = join_groups(hits, hub, "key", "size", hits.count()).where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("times"))
    best = shared.groupBy("cls").agg(F.min(F.struct((-F.col("times")).alias("fewer"), "hub"))["hub"].alias("hub"))
    judge = lambda pairs, name: durable(_judged(documents, total, pairs, classes, repeated, words, share, id_col, text_col), name)
    stars = judge(best.toDF("a", "b"), "stars")
    links = stars.where("linked").select("a", "b").unionByName(durable(_family_links(stars, share), "family-links"))
    labels = components(links)
    tried = stars.select("a", "b")
    hits = _banded(hit_sizes, classes, share)
    for nearest in (NEAREST, None):
        found = durable(_mixed_pairs(_mixed_buckets(hits, classes, labels, stars), share, nearest), "found")
        # Only buckets of which partners were left out are searched again.
        hits = hits.join(found.where("b is null").select(F.col("a").alias("key")), "key", "left_semi")
        offered = found.where("b is not null")
        seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = durable(offered.join(seen, ["a", "b"], "left_anti"), "offered")
        if new.isEmpty():
            continue
        more = judge(new, "more").where("linked").select("a", "b")
        tried = tried.unionByName(new)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return _labelled(rows, total, classes, labels, repeated), repeated


def _labelled(rows: DataFrame, total: int, classes: DataFrame, labels: DataFrame, repeated: bool) -> DataFrame:
    comp = classes.join(labels, classes["cls"] == labels["id"], "left").select("digest", "n", "doc", F.coalesce("comp", "cls").alias("comp"))
    if repeated:
        comp = durable(comp, "named")
        least = comp.groupBy("comp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("members"))
        comp = join_groups(comp, least, "comp", "members", comp.count()).withColumn("comp", F.col("least"))
    comp = comp.select("digest", "n", "comp")
    comp = durable(comp.where("n > 1 or comp is not null"), "class-components")
    placed = join_groups(rows.select("doc_id", "n_shingles", "digest"), comp, "digest", "n", total, "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", "digest", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_groups(documents: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of links of ``share`` percent similarity."""
    return _groups(documents, words, share, id_col, text_col)[0].drop("digest")


def drop_near_copies(documents: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each group keeps the one of smallest id, with the input's columns."""
    groups, repeated = _groups(documents, words, share, id_col, text_col)
    if repeated:
        groups = durable(groups.where("doc_id is not null").select("doc_id", "digest", "kept"), "rows")
    gone = durable(groups.where("not kept").select("doc_id").distinct(), "near-copies")
    total = documents.count()
    left = without_ids(documents, gone, gone.count(), total, id_col)
    if not repeated:
        return left
    # Of an id with copies and others among its rows, the others come back.
    mixed = durable(groups.join(gone, "doc_id", "left_semi").where("kept").select("doc_id", "digest").distinct(), "mixed-ids")
    if mixed.isEmpty():
        return left

    @F.pandas_udf("binary")
    def digest_of(texts: pd.Series) -> pd.Series:
        return pd.Series([set_digest(shingles(t, words)) for t in texts], dtype=object)

    maybe = id_filter(mixed.select(F.col("doc_id").alias("id")), "id", mixed.count(), total)
    some = documents if maybe is None else documents.where(maybe(F.col(id_col).cast("long")))
    some = some.withColumns({"_near_id": F.col(id_col).cast("long"), "_near_set": digest_of(F.col(text_col).cast("string"))})
    back = some.join(mixed.toDF("_near_id", "_near_set"), ["_near_id", "_near_set"], "left_semi").select(*documents.columns)
    return left.unionByName(back)
