"""Fill-in-middle, tokenizer alignment and sharding against plain loops, on texts of the tables and awkward ones."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from saffron.llm import align, infill, queries, shards, skew

from .test_text_operators import AWKWARD

SF = "/root/testdata/sf0.01"
#: Texts around the marks, the ends of runs and the ends of chunks.
EDGES = [(20, "a<P>b"), (21, "<S"), (22, "<<<M"), (23, "a" * infill.CHUNK + "b c"), (24, "a b" * (2 * infill.CHUNK)), (25, "é1" * 50_000 + "zz"), (26, "x" * (5 * infill.CHUNK)), (27, "x<" * 40_000), (24, "a b" * (2 * infill.CHUNK)), (28, "<M>" + "w " * 40_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "part", "n", "digest", "size", "shard", "_one", "_row", "bytes", "pairs")})


def counted(rows):
    return Counter(tuple(r) for r in rows)


# ---------------------------------------------------------- fill in the middle


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("giant", [infill.GIANT, 20])
def test_infill_against_plain_loops(spark, monkeypatch, giant):
    """Also with nearly all texts dealt out in chunks, and copies of one of them frequent."""
    monkeypatch.setattr(infill, "GIANT", giant)
    monkeypatch.setattr(skew, "HOT", 3)
    rows = AWKWARD + EDGES + [(30, "one hot text of several words")] * 60
    got = infill.infill_digests(infill.fill_in_middle(frame(spark, rows)))
    assert counted(got.collect()) == counted(brute_infill(*r) for r in rows)
    documents = [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    assert counted(queries.op11_infill(spark, SF).collect()) == counted(brute_infill(*r) for r in documents)
    assert infill.fill_in_middle(frame(spark, rows).limit(0)).count() == 0


def test_chunk_summaries_compose():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abXZ 1<é漢\n") for _ in range(rng.randint(0, 60)))
        units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        size = rng.randint(1, 9)
        parts = [infill.summary(infill.letters(text[i : i + size])) for i in range(0, len(text), size)]
        halves = [infill.Summary(), infill.Summary()]
        for i, s in enumerate(parts):
            halves[i >= len(parts) // 2] = halves[i >= len(parts) // 2].then(s)
        assert halves[0].then(halves[1]).starts[0] == len(units)
        before, found = infill.Summary(), []
        for i, s in enumerate(parts):
            letter = infill.letters(text[i * size : (i + 1) * size])
            found += [i * size + infill.place(letter, before.after[0], k) for k in range(s.starts[before.after[0]])]
            before = before.then(s)
        assert found == units


# -------------------------------------------------------------------- alignment


def brute_alignment(rows):
    """By the sets of byte offsets at which tokens of each library end."""
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a_path, _, b_path = align.default_paths()
    library = tokenizers.Tokenizer.from_file(a_path)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte_of = {c: b for b, c in enumerate(align.byte_letters())}
    spell_a = lambda i: bytes(byte_of[c] for c in library.id_to_token(i))
    spell_b = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := pieces.id_to_piece(i)) else p.replace("▁", " ").encode()
    out, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text, num_threads=1)
            sides = [(a, [spell_a(i) for i in a]), (b, [spell_b(i) for i in b])]
            if all(b"".join(s) == (" " + text).encode() for _, s in sides):
                ends = []
                for _, spelled in sides:
                    at, stops = 0, []
                    for s in spelled:
                        at += len(s)
                        stops.append(at)
                    ends.append(stops)
                common, at = sorted(set(ends[0]) & set(ends[1])), [0, 0]
                for stop in common:
                    group = []
                    for side in (0, 1):
                        first = at[side]
                        while at[side] < len(ends[side]) and ends[side][at[side]] <= stop:
                            at[side] += 1
                        group.append(sides[side][0][first : at[side]])
                    groups.append(group)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        out.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    sha = lambda gs: hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in gs).encode()).hexdigest() if gs else ""
    return [(i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), sha(gs)) for i, gs, ls in out]


STRANGE = [(40, "▁a"), (41, "a  b\t\tc "), (42, " lead"), (43, "ab" * 3000), (44, "\n\n\n\n x"), (45, "<s> </s> <unk> <0x41> <|endoftext|>"), (46, "ﬁ ① é é 👩‍👩‍👧"), (47, "\x00\x7f​﻿"), (48, "日本語のテキスト。" * 40)]


@pytest.mark.parametrize("pairs", [align.BROADCAST_PAIRS, 0])
def test_alignment_against_offsets(spark, monkeypatch, pairs):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", pairs)
    rows = AWKWARD + STRANGE + [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").limit(150).collect()]
    assert counted(align.alignment(frame(spark, rows)).collect()) == counted(brute_alignment(rows))
    assert align.alignment(frame(spark, rows).limit(0)).count() == 0


def test_alignment_of_all_documents(spark):
    documents = [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    assert counted(queries.op12_alignment(spark, SF).collect()) == counted(brute_alignment(documents))


def test_groups_themselves(spark):
    got = align.aligned(frame(spark, [(1, "tokenizers disagree, 漢字"), (2, None)]), groups=True).collect()
    text = " tokenizers disagree, 漢字".encode()
    own = align.aligner()
    at = 0
    for g in got[0]["groups"]:
        part = text[at : g["stop"]]
        assert b"".join(own.a_bytes[i] for i in g["a"]) == b"".join(own.b_bytes[i] for i in g["b"]) == part
        at = g["stop"]
    assert at == len(text) and got[1]["groups"] == []


def test_transducer_forgets_and_refuses(monkeypatch):
    t = align.Transducer({1: b"ab", 2: b"c", 3: b"x"}, {1: b"a", 2: b"bc", 3: b"x"})
    assert t.groups([1, 2, 3], [1, 2, 3]) == (["1,2|1,2", "3|3"], [1 << align.SHIFT | 1, 1 << align.SHIFT | 2, 2 << align.SHIFT | 1, 2 << align.SHIFT | 2, 3 << align.SHIFT | 3], [])
    monkeypatch.setattr(align, "MEMO", 0)
    monkeypatch.setattr(align, "FEW", 3)
    assert t.groups([1, 2, 1, 2], [1, 2, 1, 2]) == (["1,2|1,2"] * 2, [], [([1, 2], [1, 2])] * 2)
    with pytest.raises(ValueError, match="different bytes"):
        t.groups([3], [1])


# --------------------------------------------------------------------- sharding


def brute_pack(sizes, capacity):
    """Best fit decreasing, one group after the other."""
    rooms, homes = [], []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        room, shard = rooms.pop(at) if at < len(rooms) else (max(capacity, size), len(homes) and max(homes) + 1)
        insort(rooms, (room - size, shard))
        homes.append(shard)
    return homes


def test_packing_against_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.choice((rng.randint(1, 9), rng.randint(1, 60))) for _ in range(rng.randint(1, 80))]
        capacity = rng.randint(1, 90)
        runs, n = shards.pack(Counter(sizes).items(), capacity)
        homes = brute_pack(sizes, capacity)
        assert [s for size, start, stop, s in runs for _ in range(start, stop)] == homes and n == max(homes) + 1
        assert [size for size, start, stop, _ in runs for _ in range(start, stop)] == sorted(sizes, reverse=True)
    assert shards.pack([], 5) == ([], 0) and shards.pack([(3, 9)], 3, most=8) is None


def test_least_capacity_is_tight():
    rng = random.Random(6)
    for n in (1, 3, 8):
        counts = list(Counter(rng.randint(1, 400) for _ in range(3000)).items())
        capacity = shards.least_capacity(counts, n)
        total = sum(s * k for s, k in counts)
        assert shards.pack(counts, capacity, n) and capacity <= 1.01 * total / n


def brute_sharded(rows, n):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode()].append(r)
    sized = sorted(((len(g) * (len(t) + 1), hashlib.sha256(t).digest(), t) for t, g in groups.items()), key=lambda x: (-x[0], x[1]))
    capacity = shards.least_capacity(list(Counter(s for s, _, _ in sized).items()), n)
    homes = brute_pack([s for s, _, _ in sized], capacity)
    placed = sorted((home, i is None, i or 0, digest, len(t) + 1, zlib.crc32(t)) for (_, digest, t), home in zip(sized, homes, strict=True) for i, _ in groups[t])
    firsts, out = {}, []
    for at, (home, missing, i, _, size, crc) in enumerate(placed):
        out.append((None if missing else i, size, crc, home, at - firsts.setdefault(home, at)))
    return out


def test_sharding_against_plain_loops(spark, monkeypatch):
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    documents = [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op13_sharding(spark, SF)
    assert counted(got.select(*columns).collect()) == counted(brute_sharded(documents, 8))
    assert {(r["law"], r["grown_shard"]) for r in got.collect()} == {("bytes", None)}
    totals = [r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(totals) == 8 and max(totals) - min(totals) <= 0.001 * sum(totals)
    monkeypatch.setattr(skew, "HOT", 3)
    rows = AWKWARD + [(100 + i, "hot copies") for i in range(40)] + [(200 + i % 7, f"text {i % 20}") for i in range(80)]
    assert counted(shards.sharded(frame(spark, rows), 8).select(*columns).collect()) == counted(brute_sharded(rows, 8))
    assert shards.sharded(frame(spark, rows).limit(0), 8).count() == 0


def test_sharding_with_a_fixed_capacity(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)]
    got = shards.sharded(frame(spark, rows), capacity=500).groupBy("shard").agg(F.sum("size").alias("n"), F.collect_set("digest").alias("d")).collect()
    assert max(r["n"] for r in got) <= 500 and sum(len(r["d"]) for r in got) == 50
    assert len(got) <= -(-sum(i % 50 + 1 for i in range(400)) // 500) + 2
