import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("qrstuv") + rng.choice("wxyz")
    prose = lambda n: " ".join(word() for _ in range(n))
    leak = prose(40)
    docs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        text = prose(rng.randrange(40, 120))
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(200, docs[1][1], "en", "a", 1), (201, docs[2][1] + " more", "en", "a", 1), (202, prose(20) + " " + leak, "en", "a", 1), (203, prose(1200) + " " + " ".join(leak.split()[:13]), "en", "b", 1), (204, prose(300) + " " + " ".join(leak.split()[:12]), "en", "b", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    good = {i for i in range(200) if i % 5}
    assert len(good - set(ids["quality"])) <= 2 and len(set(ids["quality"]) & set(range(0, 200, 5))) <= 2
    assert {202, 203, 204} <= set(ids["near_duplicates"])
    assert not {200, 201} & set(ids["near_duplicates"]) and {1, 2} <= set(ids["near_duplicates"])
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - {202, 203}
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) == 2
    slots = sorted(r["slot"] for r in seen["tokens"].select("slot").collect())
    assert slots == list(range(len(slots))) and set(ids["tokens"]) == set(ids["mixing"])
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.select("doc_id", "seq_no").collect())) == sorted(map(str, seen["tokens"].select("doc_id", "seq_no").collect()))


def test_labels_of_held_out_rows_are_not_read(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out())
    assert 0 < labels.count() < 200
    assert decontam.SPAN == 13


CLASH = ["size", "source_size", "Target", "copies", "taken", "_copy", "score", "predicted", "n_words", "n_hit", "items", "hits", "node", "id", "bands", "kept"]


def test_stages_on_odd_tables(spark, folder, tmp_path):
    """Nulls in any column, empty texts, repeated rows, columns named as results are, and empty tables."""
    rows = [(1, "a few words here", "a"), (1, "a few words here", "a"), (2, None, "a"), (3, "", None), (None, "no id at all", "b"), (None, None, None), (4, "word " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    want = {"quality": None, "near_duplicates": 4, "decontamination": 7, "mixing": None, "tokens": None}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name == "tokens":
            assert {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 4}
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in CLASH), name
        assert want[name] in (None, len(got)), name
        if name == "mixing":
            assert all((r["text"] or "").strip() for r in got)
