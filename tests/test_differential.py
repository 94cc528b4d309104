"""Random queries against the row-at-a-time model: results, order, totals and facet counts."""

import random

import pytest

from facetloom import FacetDataset, load, save

from .naive import facet_counts, matches

KINDS = {"id": "id", "s": "facet", "n": "facet", "b": "facet", "tags": "facet", "x": "range", "k": "range", "m": "meta"}
WORDS = ["", "null", "undefined", "a", "A", "5", "5.0", "true", "é", "x y"]


def rows(rng, n):
    some = lambda f: None if rng.random() < 0.2 else f()
    return [
        {
            "id": i,
            "s": some(lambda: rng.choice(WORDS)),
            "n": some(lambda: rng.choice([0.0, 5.0, 5.5, -1.0, 1e-7, 1e21, float("nan")])),
            "b": some(lambda: rng.random() < 0.5),
            "tags": some(lambda: [some(lambda: rng.choice(WORDS)) for _ in range(rng.randint(0, 4))]),
            "x": some(lambda: rng.choice([0.0, -2.5, 3.25, 10.0, float("nan")])),
            "k": some(lambda: rng.randint(-5, 5)),
            "m": some(lambda: rng.choice(WORDS)),
        }
        for i in range(n)
    ]


def query(rng):
    values = [*WORDS, 5, 5.0, 5.5, 0, -1, True, False, 1e-7, 1e21, float("nan")]
    one = lambda: rng.choice(values) if rng.random() < 0.85 else None
    asked = lambda: one() if rng.random() < 0.5 else [one() for _ in range(rng.randint(0, 4))]
    names = [*KINDS, "nope"]
    weights = [1, 6, 6, 6, 6, 1, 1, 1, 0.3]
    pick = lambda: rng.choices(names, weights)[0]
    number = lambda: rng.choice([None, -5, -2.5, 0, 0.5, 3, 10, float("nan"), float("inf"), float("-inf")])
    out = {}
    if rng.random() < 0.6:
        out["equal"] = {pick(): asked() for _ in range(rng.randint(1, 2))}
    if rng.random() < 0.5:
        out["not_equal"] = {pick(): asked() for _ in range(rng.randint(1, 2))}
    if rng.random() < 0.4:
        out["ranges"] = {rng.choice(["x", "k", "x", "k", "s"]): {"min": number(), "max": number()} for _ in range(rng.randint(1, 2))}
    if rng.random() < 0.3:
        out["is_null"] = [pick()]
    if rng.random() < 0.3:
        out["is_not_null"] = [pick()]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_agrees_with_the_model(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = rows(rng, 60)
    schema = "id long, s string, n double, b boolean, tags array<string>, x double, k int, m string"
    df = spark.createDataFrame([tuple(r.values()) for r in data], schema).coalesce(2)
    config = {"dataset_id": "d", "facets": ["s", "n", "b", "tags"], "ranges": ["x", "k"]}
    made = FacetDataset.create(df, config)
    save(made, str(tmp_path / "d"))
    ds = load(spark, str(tmp_path / "d")).persist()
    for i in range(60):
        q = query(rng)
        offset, limit = rng.choice([0, 0, 3, -2]), rng.choice([None, 0, 5, 1000])
        expected = [r for r in data if matches(r, KINDS, q)]
        page = expected[max(0, offset) :][: limit if limit is not None else None]
        found = ds.query(**q, offset=offset, limit=limit, include_facet_counts=i % 4 == 0)
        got = [r["id"] for r in found.items.select("id").collect()]
        assert sorted(got) == [r["id"] for r in page] if limit is None and offset <= 0 else got == [r["id"] for r in page], q
        if i % 4 == 0:
            assert found.total == len(expected) == ds.total(**q), q
            assert found.facet_dict == facet_counts(expected, ["s", "n", "b", "tags"]), q
    ds.dispose()
