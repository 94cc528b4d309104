import itertools
import random

import pytest

import corpus_pipeline
from facetloom.llm import overlap
from facetloom.llm.components import connected_components


def naive_similar(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return bool(sets[0]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def texts():
    rng = random.Random(3)
    line = [f"c{i}" for i in range(30)]
    out = ["", "one two", "One two", None]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        out.append(" ".join(base))
        for changes in (1, 2, 4, 8):
            other = base[:]
            for _ in range(max(1, len(base) * changes // 250)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(other + (line if rng.random() < 0.2 else [])))
    return out


@pytest.mark.parametrize(("spread", "block"), [(4096, 256), (2, 1)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, spread, block):
    monkeypatch.setattr(overlap, "SPREAD", spread)
    monkeypatch.setattr(overlap, "BLOCK", block)
    rows = list(enumerate(texts()))
    edges = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if naive_similar(a or "", b or "")]
    roots = lambda df: {r["node"]: r["root"] for r in connected_components(df).collect()}
    got = roots(overlap.links(spark.createDataFrame(rows, "key long, text string")))
    assert got == roots(spark.createDataFrame(edges, "a long, b long")) and len(got) > 40


def test_the_near_stage_leaves_no_near_copy(spark, data):
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    left = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()
    assert not [1 for a, b in itertools.combinations(left, 2) if naive_similar(a["text"], b["text"])]
    assert len(left) > 25


def test_a_large_group_and_a_chain(spark, monkeypatch):
    """Many copies of one text with a word changed each, and texts of which each is like the next only."""
    monkeypatch.setattr(overlap, "SPREAD", 50)
    monkeypatch.setattr(overlap, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(150):
        other = base[:]
        other[rng.randrange(300)] = f"x{k}"
        rows.append(" ".join(other))
    chain = [f"c{i}" for i in range(200)]
    for k in range(20):
        rows.append(" ".join(chain))
        chain[k * 3] = f"d{k}"
        chain[k * 3 + 100] = f"e{k}"
    rows = list(enumerate(rows))
    edges = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if naive_similar(a, b)]
    roots = lambda df: {r["node"]: r["root"] for r in connected_components(df).collect()}
    got = roots(overlap.links(spark.createDataFrame(rows, "key long, text string")))
    assert got == roots(spark.createDataFrame(edges, "a long, b long"))
    assert overlap.links(spark.createDataFrame([], "key long, text string")).collect() == []
