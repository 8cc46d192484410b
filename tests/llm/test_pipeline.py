"""The whole pipeline against plain loops, and on tables that are empty or awkward."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saffron.llm import bpe, queries, toxicity

from .test_corpus_operators import AWKWARD, brute_components, brute_exact, brute_targets, words_of

SMALL = "/root/testdata/sf0.001"


def brute_mix(rows):
    """(id, text) as often as the mix takes it: whole epochs, then by key up to the nearest cut."""
    out, by_source = [], defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((hashlib.md5(f"{'' if i is None else i}|{text or ''}".encode()).hexdigest(), len(words_of(text)), i, text))
    sizes = {s: sum(r[1] for r in x) for s, x in by_source.items()}
    targets = brute_targets(sizes)
    for s, x in by_source.items():
        budget, before = int(targets[s] + 0.5), 0
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, n, i, text in sorted(x, key=lambda r: r[0]):
            missing = rest - before
            out += [(i, text)] * (epochs + (missing > 0 and missing >= n - missing) if n else 0)
            before += n
    return out


def test_pipeline_against_plain_loops(spark):
    tokenizers = pytest.importorskip("tokenizers")
    documents, labels = (queries.read(spark, SMALL, t) for t in ("documents", "labels"))
    model = toxicity.train(documents, labels, queries.fold(5) != 0)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows = [r for r in rows if model.score(r[1]) < 0.5]
    first = {min(ids) for ids in brute_exact(rows).values()}
    rows = [r for r in rows if r[0] in first]
    comp = brute_components([r[:2] for r in rows], 5)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    mixed = brute_mix(rows)
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()[0])
    want = Counter()
    for i, text in mixed:
        ids = library.encode(text or "", add_special_tokens=False).ids
        coded = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and 20 < len(got) < len(first) <= 200


def tables(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_pipeline_of_empty_and_awkward_tables(spark, tmp_path):
    documents, labels = (queries.read(spark, SMALL, t) for t in ("documents", "labels"))
    for n, (docs, known) in enumerate([(documents.limit(0), labels), (documents.limit(0), labels.limit(0)), (documents.limit(5), labels.limit(0))]):
        got = corpus_pipeline.run(spark, tables(spark, tmp_path / str(n), docs, known))
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (got.count() == 0) == (n < 2)
    rows = spark.createDataFrame([(i, t, None, s, None) for i, t, s in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = rows.withColumns({c: F.lit(i) for i, c in enumerate(("digest", "key", "size", "_id", "keep_id", "label", "id", "score", "_row", "cls", "ids"))})
    path = tables(spark, tmp_path / "awkward", clashing, labels)
    docs = queries.read(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), clashing.schema)
    assert docs.columns == clashing.columns
    # white space only is no word, so the mix leaves it out; "one two" stays once, as the copy of smallest id
    assert set(r["doc_id"] for r in docs.collect()) <= {4, 6} and corpus_pipeline.run(spark, path).count() == docs.count()


def test_pipeline_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    """Written results stay, stages' tables and those of operators go."""
    from saffron.llm import durable
    from saffron.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/app")
    monkeypatch.setattr(durable, "app_dir", shared.shared_dir)
    docs, labels = (queries.read(spark, SMALL, t) for t in ("documents", "labels"))
    path = tables(spark, tmp_path / "in", docs.limit(30), labels)
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "package.zip").write_bytes(b"")
    corpus_pipeline.write(spark, path, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 0
    assert [p.name for p in (tmp_path / "app").iterdir()] == ["package.zip"]
    durable.durable(docs.limit(3), "again")
    assert len(list((tmp_path / "app").iterdir())) == 2
    durable.release(spark)
    assert [p.name for p in (tmp_path / "app").iterdir()] == ["package.zip"]
