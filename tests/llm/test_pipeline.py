"""The pipeline against a version of its own in plain Python."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from facetloom.llm import quality

from . import test_decontam, test_mixing, test_simhash
from .test_exact_dedup import lowered
from .test_overlap import naive_similar


def near_roots(texts):
    """The first place that links of either kind reach from each text."""
    roots = test_simhash.brute_components([test_simhash.naive_fingerprint(t) for t in texts])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if roots[i] != roots[j] and naive_similar(texts[i] or "", texts[j] or ""):
            low, high = sorted((roots[i], roots[j]))
            roots = [low if r == high else r for r in roots]
    return roots


def brute(rows, bench, model):
    rows = [r for r in rows if model.score(np.stack([quality.features(r["text"])]))[0] >= quality.CUT]
    stays = {}
    for r in rows:
        k = lowered(r["text"])
        if k not in stays or r["doc_id"] > stays[k]["doc_id"]:
            stays[k] = r
    rows = sorted(stays.values(), key=lambda r: r["doc_id"])
    roots = near_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    leaks = {i for i, _ in test_decontam.brute([(r["doc_id"], r["text"]) for r in rows], test_decontam.items_of(bench))}
    rows = [r for r in rows if r["doc_id"] not in leaks]
    copies = {i: n for i, _, n in test_mixing.brute_copies([(r["doc_id"], r["source"], r["text"]) for r in rows])}
    return sorted(tuple(r.values()) for r in rows for _ in range(copies[r["doc_id"]]))


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = corpus_pipeline.run(spark, data)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, bench, model)


def test_stages_keep_the_columns_and_stand_odd_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, leaks int"
    text = "A plain sentence that says something. And then another one follows it.\nWith a second line too."
    rows = [(1, text, "en", "s", 1, "k", 1), (1, text, "en", "s", 1, "k", 1), (None, text, None, None, None, None, None), (2, None, None, "s", 0, None, 1), (3, "", "en", None, 0, "x", 2), (4, text + " More words at the very end of it.", "en", "s", 1, "k", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), data).collect() == [], name
    assert corpus_pipeline.exact_stage(spark, docs, data).count() == 3
    assert corpus_pipeline.mixing_stage(spark, docs, data).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]


@pytest.mark.parametrize("at", [1, 2])
def test_rows_keep_their_numbers_when_the_scan_is_split_anew(spark, data, tmp_path, monkeypatch, at):
    """The table is split into other partitions, in another order, for each scan of a stage."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.union(docs.limit(60)).repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    name, stage = corpus_pipeline.STAGES[at]
    expected = sorted(tuple(r) for r in stage(spark, docs, data).collect())
    module, found = (corpus_pipeline.exact_dedup, "exact_dedup") if at == 1 else (corpus_pipeline.simhash, "near_dedup")
    plain = getattr(module, found)

    def then_split(*args, **named):
        out = plain(*args, **named)
        spark.conf.set(key, "20000")
        return out

    monkeypatch.setattr(module, found, then_split)
    try:
        got = sorted(tuple(r) for r in stage(spark, docs, data).collect())
    finally:
        spark.conf.set(key, before)
    assert got == expected and len(got) == len({(lowered(r[1]) if at == 1 else r[0]) for r in got}), name


def test_folders_of_earlier_stages_go(spark, data, monkeypatch):
    made = []
    plain = corpus_pipeline.new_folder
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda s, kind: made.append(plain(s, kind)) or made[-1])
    left = corpus_pipeline.run(spark, data)
    assert left.count() > 0
    stages = [f for f in made if "/pipeline-" in f]
    fs = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f))
    assert [fs(f) for f in stages] == [False] * 4 + [True]
