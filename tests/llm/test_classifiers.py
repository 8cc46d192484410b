"""The classifiers against plain loops, and on learning tables that are empty, sparse or repeat ids."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saffron.llm import labelled, quality, toxicity

WORDS = ["stone", "river", "cloud", "lamp", "paper", "green", "table", "walk", "seven", "north"]
RUDE = ["gruk", "blarg", "zzyx"]


def corpus(spark, n=120):
    """Documents of which every third one holds rude words, and their labels."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[j] for j in rng.integers(0, len(WORDS), 30)]
        if i % 3 == 0:
            words[int(rng.integers(0, 30))] = RUDE[i % 2] if i % 9 else "Ж" + RUDE[2]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0), int(i % 3 != 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def scores(module, documents, model):
    run = module.quality if module is quality else module.toxicity
    return {r["doc_id"]: r["score"] for r in run(documents, model).collect()}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_and_sparse_learning_tables(spark, module):
    docs, labels = corpus(spark, 12)
    assert set(scores(module, docs, module.train(docs.limit(0), labels, F.lit(True))).values()) == {0.5}
    assert set(scores(module, docs, module.train(docs, labels.limit(0), F.lit(True))).values()) == {0.5}
    # two labelled documents, one of each class: no n-gram stands in four of them
    two = module.train(docs.where("doc_id in (0, 1)"), labels, F.lit(True))
    assert all(0 <= s <= 1 for s in scores(module, docs, two).values()) and scores(module, docs.limit(0), two) == {}
    assert set(scores(module, docs, module.train(docs, labels.selectExpr("doc_id + 1000 AS doc_id", "toxic", "quality"), F.lit(True))).values()) == {0.5}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_repeated_ids_do_not_flood_the_sample(spark, module):
    docs, labels = corpus(spark, 60)
    copies = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("flood "), (F.col("id") % 700).cast("string")).alias("text"))
    flooded = docs.where("doc_id > 2").unionByName(copies)
    once = labels.unionByName(labels).unionByName(labels.where("doc_id = 7").selectExpr("doc_id", "1 - toxic AS toxic", "1 - quality AS quality"))
    got = [scores(module, docs, module.train(flooded.repartition(n), once.repartition(n), F.lit(True), per_class=20)) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    sample, counts = labelled.labelled_sample(flooded, once, "toxic", F.lit(True), 20)
    rows = sample.collect()
    assert counts == {0: 40, 1: 20} and len(rows) == 40 == len({r["id"] for r in rows}) and Counter(r["label"] for r in rows) == {0: 20, 1: 20}


def test_grams_are_of_characters(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 40)
    text = "Жя漢字🙂 Ab"
    padded = f" {text.lower()} "
    want = {padded[i : i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)}
    assert len(toxicity.grams(text)) == len(want)
    assert len(np.intersect1d(toxicity.grams("xxЖя漢字yy"), toxicity.grams("qЖя漢字z"))) == 1  # the one shared 4-gram
    monkeypatch.setattr(toxicity, "PIECE", 5)
    assert len(toxicity.grams(text)) == len(want)
    assert len(toxicity.grams(None)) == len(toxicity.grams("")) == 0


def test_ratios_and_scores_against_plain_counting(spark):
    docs, labels = corpus(spark)
    texts, toxic = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    n1 = sum(toxic.values())
    n0 = len(toxic) - n1
    held = {0: Counter(), 1: Counter()}
    grams_of = {i: {f" {t.lower()} "[a : a + n] for n in toxicity.SIZES for a in range(len(t) + 3 - n)} for i, t in texts.items()}
    for i, found in grams_of.items():
        held[toxic[i]].update(found)
    want = {}
    for g in held[0] | held[1]:
        a, b = held[1][g], held[0][g]
        p1, p0, p = (a + 1) / (n1 + 2), (b + 1) / (n0 + 2), (a + b + 1) / (n0 + n1 + 2)
        if a + b >= toxicity.SUPPORT and abs(p1 - p0) >= toxicity.TELLING * np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12):
            want[g] = np.log(p1 / p0)
    place = {g: int(h) for g in want for h in [next(iter(np.setdiff1d(hashes(g), [])))]}
    assert len(set(place.values())) == len(place) > 5
    rows = spark.createDataFrame([(toxic[i], t) for i, t in texts.items()], "label int, text string")
    got = {r["feature"]: r["ratio"] for r in toxicity.log_ratios(toxicity._counts(rows), n0, n1).collect()}
    assert got.keys() == set(place.values()) and all(got[place[g]] == pytest.approx(r) for g, r in want.items())
    model = toxicity.train(docs, labels, F.lit(True))
    weight = {g: model.weights[model.table[h]] for g, h in place.items()}
    for i, s in scores(toxicity, docs, model).items():
        z = model.bias + sum(weight[g] for g in grams_of[i] if g in weight)
        assert s == pytest.approx(1 / (1 + np.exp(-z))) and (s >= 0.5) == bool(toxic[i])
    # at the optimum the gradient of the regularised loss is zero
    names = list(want)
    x = np.array([[want[g] * (g in grams_of[i]) for g in names] for i in texts])
    beta = np.array([weight[g] / want[g] for g in names])
    y = np.array([toxic[i] for i in texts])
    p = 1 / (1 + np.exp(-(x @ beta + model.bias)))
    assert np.abs(x.T @ (p - y) + toxicity.RIDGE * beta).max() < 0.02 and abs((p - y).sum()) < 0.02


def hashes(gram):
    """The feature of one n-gram."""
    points = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    return [h for n, h in zip(toxicity.SIZES, toxicity._grams(points), strict=False) if n == len(gram)][0]


def test_votes_against_plain_loops(spark):
    """Terms by counting, a full decomposition and one cosine at a time give the same scores."""
    docs, labels = corpus(spark, 40)
    docs = docs.unionByName(spark.createDataFrame([(100, None), (101, ""), (102, "x"), (103, "stone stone Ж漢 12.\n\tEnd")], "doc_id long, text string"))
    model = quality.train(docs, labels, F.lit(True))
    texts, label = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}

    def kind(b):
        c = chr(b)
        return 1 if c in "abcdefghijklmnopqrstuvwxyz" else 2 if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3 if c in "0123456789" else 4 if c in " \t" else 5 if c in "\n\v\f\r" else 6 if c in ".," else 7 if b > 127 else 0

    def plain_terms(text):
        raw = (text or "").encode()
        shapes, grams = np.zeros(quality.SHAPES), np.zeros(quality.TRIGRAMS)
        for i in range(len(raw) - 3):
            shapes[int("".join(str(kind(b)) for b in raw[i : i + 4]), 8)] += 1
        for i in range(len(raw) - 2):
            grams[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 21] += 1
        words = (text or "").lower().split()
        stats = []
        if words:
            times = Counter(words)
            again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1) if len(words) > 1 else 0
            values = [len(times) / len(words), max(times.values()) / len(words), again, np.log2(len(words) + 1) / 16, len(raw) / len(words) / 16, sum(kind(b) == 0 for b in raw) / len(raw) * 4]
        for k in range(6):
            bins = np.zeros(16)
            if words:
                at = min(max(values[k], 0), 1) * 15
                low = min(int(at), 14)
                bins[low], bins[low + 1] = low + 1 - at, at - low
            stats.append(bins / 2)
        return np.concatenate([np.sqrt(shapes / max(1, shapes.sum())), np.sqrt(grams / max(1, grams.sum())), *stats])

    known = sorted(label)
    x = np.stack([plain_terms(texts[i]).astype(np.float16) for i in known]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    axes = np.linalg.svd(x * idf, full_matrices=False)[2][: quality.AXES]
    vectors = {i: axes @ (plain_terms(texts[i]) * idf) for i in texts}
    share = np.mean([label[i] for i in known])
    got = scores(quality, docs, model)
    for i, v in vectors.items():
        cosines = sorted(((float(v @ vectors[j] / max(1e-9, np.linalg.norm(v) * np.linalg.norm(vectors[j]))), j) for j in known), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 1e-3) ** quality.SHARP, label[j]) for c, j in cosines]
        assert 0 < share < 1 and got[i] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=0.02)
