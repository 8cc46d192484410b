"""Mixing, dedup, classifiers, preferences and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saffron.llm import components, exact, fuse, mixing, near, oracle, preference, quality, queries, skew, toxicity

SF = "/root/testdata/sf0.01"
AWKWARD = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one two", "b"), (4, "one two", "b"), (5, "One\t two ", None), (6, "word " * 30_000, "a"), (None, "one two", "b"), (None, None, None), (7, "one  two", "c")]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, source string").withColumns({"digest": F.lit("x"), "key": F.lit(1), "size": F.lit(2), "_id": F.lit(3), "taken": F.lit(4), "n": F.lit(5)})


def sql(name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = con.sql(oracle.ORACLE_SQL[name])
    return sorted(map(tuple, out.fetchall()), key=repr), out.columns


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    want, columns = sql(name)
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


# ------------------------------------------------------------------ mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_targets_against_brute_force(spark):
    rng = random.Random(4)
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 0}, {None: 9}, {f"s{i:02}": rng.choice([0, 1, 10, 1000]) for i in range(17)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixture_of_awkward_rows(spark):
    rows = mixing.mixture(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    size = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["taken"]
    for r in rows:
        assert abs(size[r["source"]] - r["target"]) <= 0.5
    assert sorted(map(tuple, mixing.mixture(awkward(spark)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mixture(awkward(spark).limit(0)).count() == 0 and mixing.mixed(awkward(spark).limit(0)).count() == 0
    assert mixing.mixed(awkward(spark)).columns == awkward(spark).columns


def test_mixed_documents_stay_whole_and_near_their_targets(spark):
    documents = queries.read(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = mixing.mixed(documents).collect()
    words, longest, targets = Counter(), defaultdict(int), {r["source"]: r["target"] for r in mixing.mixture(documents).collect()}
    for r in out:
        assert r["text"] == text[r["doc_id"]]
        n = len(re.findall(r"[^ \t-\r]+", r["text"]))
        words[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    assert all(abs(words[s] - t) <= max(longest[s], 7000) / 2 + 1 for s, t in targets.items())
    assert max(Counter(r["doc_id"] for r in out).values()) <= 3


def test_mixed_takes_only_some_of_repeated_rows(spark):
    """Rows that share the key at the cut: of equal id and text, some with other columns."""
    rows = [(None, "one two three four five six", "a", i) for i in range(1000)] + [(i, "w " * 30, "b", i) for i in range(200)] + [(5, "x y", None, i) for i in range(77)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    target = {r["source"]: r["target"] for r in mixing.mixture(docs).select("source", "target").distinct().collect()}
    got, words = mixing.mixed(docs.repartition(5)), Counter()
    for r in got.collect():
        words[r["source"]] += len(r["text"].split())
    assert got.columns == docs.columns and words.keys() == target.keys()
    assert all(abs(words[s] - t) <= {"a": 3, "b": 15, None: 1}[s] + 0.5 for s, t in target.items()), (words, target)
    assert target["a"] % 6000 and max(Counter((r["source"], r["size"]) for r in got.collect()).values()) <= 3


def test_prefix_sums_over_ranges(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 11).alias("v"))
    got = {r["id"]: r["before"] for r in mixing.prefix_sums(rows, [F.col("id").desc()], {"before": "v"}, "test").collect()}
    total = 0
    for i in reversed(range(500)):
        assert got[i] == total
        total += i * 37 % 11


# ------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_fuse_filters_never_miss(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.may_hold(f, keys).all()
    assert fuse.may_hold(f, rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    return groups


@pytest.mark.parametrize("in_snapshot", [None, "all", "none"])
def test_exact_groups_of_awkward_rows(spark, in_snapshot):
    side = {None: None, "all": F.lit(True), "none": F.lit(False)}[in_snapshot]
    got = exact.exact_groups(awkward(spark), side).collect()
    want = []
    for ids in brute_exact(AWKWARD).values():
        keep = min((i for i in ids if i is not None), default=None) if len(ids) > 1 else ids[0]
        want += [(i, keep, len(ids), keep == i) for i in ids]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert exact.exact_groups(awkward(spark).limit(0)).count() == 0


def test_snapshot_is_kept_for_later_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 100)
    rows = lambda lo, hi: exact.buckets_of(spark.range(lo, hi).select(F.col("id").alias("doc_id"), exact.digest(F.concat(F.lit("text "), (F.col("id") % 700).cast("string"))).alias("digest")))
    exact.save_snapshot(exact.snapshot_of(rows(0, 500)), str(tmp_path / "one"))
    kept = exact.load_snapshot(spark, str(tmp_path / "one"))
    assert kept.shards == 5 and kept.filters.count() == 5
    screened = exact.screen(rows(300, 1000), kept)
    assert screened.where("maybe").count() >= 500 and screened.where("not maybe").count() > 190  # 0 to 499 are held, 500 to 699 aren't
    merged = {r["keep_id"]: r["group_size"] for r in exact.merge_batch(kept, rows(300, 1000)).collect()}
    assert merged == {i: 1 + (i < 300) + (300 <= i < 500) for i in range(700)}


def test_batch_against_an_empty_snapshot_is_spread(spark, monkeypatch):
    empty = exact.snapshot_of(spark.createDataFrame([], "digest binary, keep_id long, group_size long"))
    batch = spark.range(1_000_000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    largest = exact.screen(batch, empty).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if("maybe").alias("held")).collect()
    assert sum(r["n"] for r in largest) == 1_000_000 and len(largest) > 1 and max(r["n"] for r in largest) < 600_000 and not any(r["held"] for r in largest)


def test_exact_drop(spark):
    left = exact.drop_copies(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([min(i for i in ids if i is not None) for ids in brute_exact(AWKWARD).values()], key=repr)


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "digest", lambda text: F.unhex(F.sha2(F.substring(exact.normalised(text), 1, 1), 256)))
    rows = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ac"), (4, "ab"), (5, "b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(rows).collect()}
    assert got == {1: (1, 2), 4: (1, 2), 2: (2, 2), 3: (2, 2), 5: (5, 1)}


def test_hot_bucket_is_compared_in_places(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 5)
    monkeypatch.setattr(skew, "HOT", 5)
    rows = spark.createDataFrame([(i, "same text") for i in range(60)] + [(100 + i, f"text {i}") for i in range(30)], "doc_id long, text string")
    got = exact.exact_groups(rows).collect()
    assert sum(r["kept"] for r in got) == 31 and {r["group_size"] for r in got} == {60, 1}


# -------------------------------------------------------------- near dedup


def words_of(text):
    return re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else zip(*(w[i:] for i in range(k)), strict=False))


def brute_components(rows, k, share=80):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= share * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("aBé \t\n漢") for _ in range(n)) for n in (0, 1, 50, 3000)] + ["x" * 9000, " " * 9000, "word " * 3000]
    whole = [near.word_hashes(t) for t in texts]
    monkeypatch.setattr(near, "PIECE", 7)
    for t, want in zip(texts, whole, strict=True):
        assert np.array_equal(near.word_hashes(t), want) and len(want) == len(words_of(t))


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_against_all_pairs(spark, k):
    documents = queries.read(spark, SF, "documents").select("doc_id", "text")
    want = brute_components([tuple(r) for r in documents.collect()], k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_groups(documents, k, 80).collect()}
    assert got == want


def test_near_family_whose_members_differ_from_their_hub(spark, monkeypatch):
    """Many variants of one text, chained and apart, with blocks small enough to need several."""
    monkeypatch.setattr(near, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(near, "BUCKET_BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        text = list(base)
        for at in rng.sample(range(80), rng.choice([1, 4, 8, 10, 14])):
            text[at] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_pigeonhole_finds_all_pairs_under_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, near.HASHES).astype(np.uint16)
    rows = [(0, bytearray(base.tobytes()))]
    for i in range(1, 60):
        other = base.copy()
        other[rng.permutation(near.HASHES)[: near.THRESHOLD]] ^= 1
        rows.append((i, bytearray(other.tobytes())))
    keys = near.index_keys(spark.createDataFrame(rows, "cls long, sig binary"))
    mine = keys.where("cls = 0").select("key")
    assert keys.join(mine, "key").select("cls").distinct().count() == 60


def test_near_awkward_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_groups(awkward(spark), 2, 80).collect()}
    assert (1, 0, 1, True) in got and (3, 0, 3, True) in got and (4, 1, 4, True) in got and (5, 1, 4, False) in got and (7, 1, 4, False) in got and (6, 1, 6, True) in got
    assert (None, 1, None, True) in got and (None, 0, None, True) in got
    assert near.near_groups(awkward(spark).limit(0)).count() == 0
    left = near.drop_near_copies(awkward(spark), 2)
    assert left.columns == awkward(spark).columns and sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 4, 6, None, None], key=repr)


def test_near_id_with_a_linked_and_an_unlinked_text(spark):
    base = [f"w{i}" for i in range(60)]
    near_base = " ".join([*base[:-1], "other"])
    far = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, " ".join(base)), (5, near_base), (5, far("x")), (6, far("x") + " more"), (6, far("x") + " more"), (7, near_base + " too"), (7, far("y")), (8, far("z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_groups(df, 2).collect())
    want = [(1, 59, 1, True), (5, 59, 1, False), (5, 59, 5, True), (6, 60, 5, False), (6, 60, 5, False), (7, 59, 7, True), (7, 60, 1, False), (8, 59, 8, True)]
    assert got == want
    left = near.drop_near_copies(df, 2)
    assert left.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([rows[0], rows[2], rows[6], rows[7]])


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.components(links.limit(0)).count() == 0


# -------------------------------------------------------------- classifiers


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    rows = got.join(queries.read(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_awkward_rows(spark, module):
    documents, labels = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels")
    model = module.train(documents, labels, F.lit(True))
    run = module.quality if module is quality else module.toxicity
    got = run(awkward(spark), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert run(awkward(spark).limit(0), model).count() == 0
    none = module.train(documents, labels, F.lit(False))
    assert {r["score"] for r in run(awkward(spark), none).collect()} == {0.5}
    one_class = module.train(documents, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)}), F.lit(True))
    assert all(r["predicted"] == 1 for r in run(awkward(spark), one_class).collect())


@pytest.mark.parametrize("block", [3, 20])
def test_near_buckets_parted_by_size(spark, monkeypatch, block):
    """Texts that share a passage but differ otherwise, of many lengths, some of them near copies."""
    monkeypatch.setattr(near, "BUCKET_BLOCK", block)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 70))]
        rows.append((3 * i, " ".join(passage + own)))
        if i % 4 == 0:
            rows.append((3 * i + 1, " ".join(passage + own[:-1] + ["new"])))
        if i % 9 == 0:  # longer by a little less than the largest factor
            rows.append((3 * i + 2, " ".join(passage + own + [f"z{j}" for j in range((len(passage) + len(own) - 1) // 4 - 1)])))
    parted = []
    real = near._banded
    monkeypatch.setattr(near, "_banded", lambda found, *a: parted.append((found.count(), real(found, *a))) or parted[-1][1])
    want = brute_components(rows, 2)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert parted[0][1].count() > parted[0][0]
    assert near._banded(spark.createDataFrame([(1, 2, 9)], "key long, cls long, size long"), spark.createDataFrame([(2, 7)], "cls long, n_shingles long"), 100).count() == (2 if block < 9 else 1)


def test_near_groups_of_one_id_on_many_rows(spark, monkeypatch):
    """Pairs of a repeated id are judged once a text, however many rows carry it."""
    words = [f"w{i}" for i in range(120)]
    base, close = " ".join(words), " ".join([*words[:-3], "x", "y", "z"])
    rows = [(7, base if i % 2 else close) for i in range(5000)] + [(8, " ".join([*words[:-1], "q"])), (9, "something else entirely of its own words")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    judged = []
    real = near._judged
    monkeypatch.setattr(near, "_judged", lambda *a: judged.append(near.durable(real(*a), "seen")) or judged[-1])
    got = near.near_groups(documents, 2).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, 5000), (8, 7, 1), (9, 9, 1)}
    assert 0 < sum(j.count() for j in judged) <= 6


# -------------------------------------------------------------- preferences


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "pair long, side string, turn long, role string, text string")


def test_preference_prefix_and_masks(spark):
    same = [(0, "system", "be kind"), (1, "user", "hi")]
    rows = [(1, s, *t) for s in ("chosen", "rejected") for t in same]
    rows += [(1, "chosen", 2, "assistant", "hello"), (1, "rejected", 2, "assistant", "go away"), (1, "rejected", 3, "user", "oh")]
    rows += [(2, "chosen", 0, "user", "only one side"), (3, "chosen", 0, None, None), (3, "rejected", 0, None, None), (None, "chosen", 0, "user", "x"), (4, "chosen", None, "user", "x")]
    parts = preference.preference_turns(pairs_of(spark, rows))
    got = {r["pair"]: r for r in preference.records(parts).collect()}
    assert got[1]["prompt"] == "<|system|>\nbe kind\n<|end|>\n<|user|>\nhi\n<|end|>\n" and got[1]["complete"]
    cut = lambda text, spans: [text[s["start"] : s["stop"]] for s in spans]
    assert cut(got[1]["chosen"], got[1]["chosen_mask"]) == ["<|assistant|>\nhello\n<|end|>\n"]
    assert cut(got[1]["rejected"], got[1]["rejected_mask"]) == ["<|assistant|>\ngo away\n<|end|>\n"]
    assert got[1]["rejected"].endswith("<|user|>\noh\n<|end|>\n")
    assert got[2]["prompt"] == "" and not got[2]["complete"] and got[2]["rejected"] == ""
    assert got[3]["prompt"] == "<||>\n\n<|end|>\n" and got[3]["chosen"] == "" and set(got) == {1, 2, 3}
    assert preference.preference_turns(pairs_of(spark, [])).count() == 0


def test_preference_repeated_turn_numbers(spark):
    rows = [(1, s, 0, "user", t) for s in ("chosen", "rejected") for t in ("b", "a")] + [(1, "chosen", 1, "assistant", "x"), (1, "chosen", 1, "assistant", "x"), (1, "rejected", 1, "assistant", "x")]
    got = preference.records(preference.preference_turns(pairs_of(spark, rows))).first()
    assert got["prompt"] == "<|user|>\na\n<|end|>\n<|user|>\nb\n<|end|>\n" and got["chosen"].count("x") == 2 and got["rejected"].count("x") == 1


def test_preference_pairs_query(spark):
    sha = lambda x: hashlib.sha256(x).digest()
    turns_of = lambda text: [t + "\n<|end|>\n" for t in text.split("\n<|end|>\n")[:-1]]
    same = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")]
    extra = pairs_of(spark, [*same, (1, "chosen", 1, "assistant", "yé"), (1, "chosen", 1, "assistant", "x"), (1, "chosen", 2, "user", None), (1, "chosen", 3, "assistant", "z"), (2, "rejected", 0, "assistant", "n")])
    for parts, got in ((preference.preference_turns(extra), None), (queries.op10_preference(spark, SF), queries.QUERIES["op10_preference_pairs"](spark, SF))):
        got = {r["pair"]: r for r in (preference.pair_digests(parts) if got is None else got).collect()}
        want = {r["pair"]: r for r in preference.records(parts).collect()}
        assert got.keys() == want.keys()
        for p, r in want.items():
            for part in ("prompt", "chosen", "rejected"):
                turns = turns_of(r[part])
                assert (got[p][f"{part}_turns"], got[p][f"{part}_chars"]) == (len(turns), len(r[part]))
                assert got[p][f"{part}_sha256"] == hashlib.sha256(b"".join(sha(t.encode()) for t in turns)).hexdigest()
            assert all(got[p][f"{s}_mask"] == ",".join(f"{x['start']}:{x['stop']}" for x in r[f"{s}_mask"]) for s in ("chosen", "rejected")) and got[p]["complete"] == r["complete"]


def brute_counterparts(rows):
    """(pair, chosen text, rejected text) by plain loops."""
    conv = {}
    for i, turn, role, text in rows:
        if i is not None and turn is not None:
            conv.setdefault(i, []).append((turn, role or "", text or ""))
    last = {i: max((t, x) for t, r, x in turns if r == "assistant") for i, turns in conv.items() if any(r == "assistant" for _, r, _ in turns)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(last, key=lambda i: (sha(last[i][1]), hashlib.md5(str(i).encode()).hexdigest(), i))
    answers = [last[i][1] for i in order]
    render = lambda turns: "".join(f"<|{r}|>\n{x}\n<|end|>\n" for _, r, x in sorted(turns))
    out = {}
    for place, i in enumerate(order):
        alike = [k for k, a in enumerate(answers) if a == answers[place]]
        if len(alike) == len(order):
            continue
        other = answers[(alike[-1] + 1 + (place - alike[0]) % (len(order) - len(alike))) % len(order)]
        before = [t for t in conv[i] if t[0] < last[i][0]]
        out[i] = render([t for t in conv[i] if t[0] <= last[i][0]]), render(before) + f"<|assistant|>\n{other}\n<|end|>\n", render(before)
    return out


def test_preference_counterparts(spark, monkeypatch):
    """Both sides end at the last assistant turn; the rejected one has an answer that differs."""
    monkeypatch.setattr(skew, "HOT", 3)
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "thanks"), (2, 0, "system", "s"), (2, 1, "user", "q2"), (2, 2, "assistant", "x"), (2, 3, "user", "?"), (2, 4, "assistant", "a2")]
    rows += [(3, 0, "user", "alone"), (4, 0, "assistant", None), (None, 0, "user", "x"), (4, None, "user", "x"), (1, 1, "assistant", "a0")]
    alike = [(i, t, r, x) for i in range(10, 40) for t, r, x in ((0, "user", f"q{i}"), (1, "assistant", "same"), (2, "user", "more"))]
    for some in (rows, rows + alike, alike, alike + [(50, 0, "assistant", "other")]):
        conv = spark.createDataFrame(some, "conv_id long, turn long, role string, text string").withColumns({"pair": F.lit("clash"), "side": F.lit(1), "n": F.lit(2), "_alike": F.lit(3)})
        want = brute_counterparts(some)
        got = {r["pair"]: r for r in preference.records(preference.preference_turns(preference.counterparts(conv))).collect()}
        assert set(got) == set(want) and all(r["complete"] for r in got.values())
        for i, r in got.items():
            assert (r["prompt"] + r["chosen"], r["prompt"] + r["rejected"]) == want[i][:2] and r["prompt"] == want[i][2]
            assert r["chosen"].endswith("<|end|>\n") and "<|user|>" not in r["chosen"] + r["rejected"] and r["chosen"] != r["rejected"]
    assert 3 not in got and preference.counterparts(conv.limit(0)).count() == 0
    assert preference.counterparts(spark.createDataFrame(alike, conv.select("conv_id", "turn", "role", "text").schema)).count() == 0


def test_preference_very_long_turn_and_hot_pair(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 3)
    rows = [(1, i, "assistant" if i % 2 else "user", "word " * 20) for i in range(400)] + [(2, 0, "user", "é" * 2_000_000), (2, 1, "assistant", "ok"), (3, 0, "user", "q"), (3, 1, "assistant", "a")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r["pair"]: r for r in preference.pair_digests(preference.preference_turns(preference.counterparts(conv))).collect()}
    assert (got[1]["prompt_turns"], got[1]["chosen_turns"], got[1]["rejected_turns"]) == (399, 1, 1) and got[2]["prompt_chars"] == 2_000_018
    assert got[1]["chosen_mask"] == f"0:{100 + 23}" and got[3]["chosen_mask"] == "0:24"


# ----------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = queries.read(spark, SF, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in queries.read(spark, SF, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept[name] = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = [i for i, y in labels.items() if y]
    assert np.mean([i in set(kept["toxicity"]) for i in toxic]) < 0.3 and np.mean([i in set(kept["toxicity"]) for i, y in labels.items() if not y]) > 0.99
    assert len(kept["exact_dedup"]) == len(set(kept["exact_dedup"])) < len(kept["toxicity"])
    assert set(kept["near_dedup"]) < set(kept["exact_dedup"]) and set(kept["mixing"]) <= set(kept["near_dedup"])
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(kept["mixing"])
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=repr) == sorted((tuple(r) for r in final.collect()), key=repr)


def test_plain_joins_where_filters_would_be_too_large(spark, monkeypatch):
    from saffron.llm import idfilter

    monkeypatch.setattr(idfilter, "MOST", 0)
    monkeypatch.setattr(exact, "FILTER_KEYS", 0)
    documents = queries.read(spark, SF, "documents")
    want = brute_components([tuple(r) for r in documents.select("doc_id", "text").collect()], 2)
    assert {r["doc_id"]: r["component_id"] for r in near.near_groups(documents, 2).collect()} == {i: c for i, (_, c) in want.items()}
    assert exact.drop_copies(documents).count() == len(brute_exact([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]))
    assert near.drop_near_copies(documents, 2).count() == sum(i == c for i, (_, c) in want.items())


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS_A_TASK", 10)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(200, i) for i in range(201, 240)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    ids = {i for p in links for i in p}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r["id"]: r["comp"] for r in got} == {i: top(i) for i in ids} and len(got) == len(ids)
