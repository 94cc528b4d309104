import hashlib
import random

import pytest

from facetloom.llm import exact_dedup as x
from facetloom.llm.common import ascii_lower
from pyspark.sql import functions as F


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    rank = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[lowered(t)], key=rank), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows), key=str)


def rows_of(rng, n):
    base = ["", "A", "aB", "É é", "x" * 9, "abcdefgh" * 3, "ABCDefgh" * 3 + "x", "ü" * 11, "longer text with words " * 40]
    out = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.4:
            t = t.upper() if t.isascii() else t
        if rng.random() < 0.3:
            t += rng.choice("xyz")
        out.append((rng.choice([i, i, None, i // 2]), None if rng.random() < 0.05 else t))
    return out


@pytest.mark.parametrize("size", [1, 3, 8, 4096])
def test_groups(spark, size):
    rows = rows_of(random.Random(size), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS kept")
    got = x.exact_dedup(df, size=size).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    kept = {}
    for r in got:
        kept.setdefault(r["text_sha256"], []).append((r["kept"], r["id"] == r["keep_id"]))
    assert all(sum(k for k, _ in v) == 1 and all(same for k, same in v if k) for v in kept.values())


def test_texts_that_differ_late_or_in_length(spark):
    long = "0123456789" * 50_000
    rows = [(1, long), (2, long), (3, long[:-1] + "x"), (4, long + "0"), (5, "x" + long[1:])]
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_a_hot_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'HOT text', concat('t', id)) AS text")
    got = x.exact_dedup(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("keep_id = 2997 AND group_size = 1000").count() == 1000


def test_empty_table(spark):
    assert x.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉ İ K AZ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == [None if t is None else lowered(t) for t in texts]
