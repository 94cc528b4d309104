import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from facetloom.llm import decontam as d


def naive_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert d.common_length(a, b) == naive_common(a, b)


def test_contains():
    words = [b"a", b"b", b"a", b"c"]
    assert d.contains(words, [b"a", b"c"]) and not d.contains(words, [b"b", b"c"]) and not d.contains(words, [])


def test_words():
    assert d.words_of("The (End), naïve-co\tX!") == ["the".encode(), b"end", "naïve".encode(), b"co", b"x"]
    assert d.words_of(None) == d.words_of("?!") == []


def test_singular_vectors():
    rng = np.random.default_rng(0)
    low = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 40)) * 3
    a = low + rng.normal(size=(200, 40)) * 0.01
    gauss = rng.normal(size=(40, 15))
    found = d.singular_vectors(a.T @ (a @ gauss), gauss)
    exact = np.linalg.svd(a, full_matrices=False)[2][:5].T
    assert np.allclose(np.linalg.norm(found[:, :5].T @ exact, axis=0), 1, atol=1e-3)
    assert d.singular_vectors(np.zeros((4, 2)), np.ones((4, 2))).shape == (4, 0)


def test_product_is_of_passages():
    """The tasks' product against one made from dense passages."""
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(60)]
    texts = [" ".join(w.decode() for w in rng.choices(words, k=rng.randint(0, 150))) for _ in range(12)] + ["", None]
    item = d.Item(1, words[:30], words[:5])
    df = np.zeros(1 << d.DF_BITS)
    terms = d.describe([item], df, 10.0)
    rank = 7
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    packed, again = d.products(iter([batch]), [(terms, rank), (terms, rank)])
    assert again.column("data") == packed.column("data") and again.column("part")[0].as_py() == 1 << d.PART_BITS
    got = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, rank) for x in packed.column("data").to_pylist()])
    rows = []
    for text in texts:
        own = d.words_of(text)
        blocks = [own[i : i + d.BLOCK_WORDS] for i in range(0, len(own), d.BLOCK_WORDS)]
        for i in range(len(blocks)):
            both = blocks[i] + (blocks[i + 1] if i + 1 < len(blocks) else [])
            rows.append((both, True))
    dense = np.zeros((len(rows), len(terms.idf)))
    for k, (both, _) in enumerate(rows):
        size = 0.0
        for w in both:
            h = int(d.hashes_of([w])[0])
            size += float(terms.df_idf[h & ((1 << d.DF_BITS) - 1)]) ** 2
            c = terms.columns.get(h & ((1 << d.LUT_BITS) - 1))
            if c is not None:
                dense[k, c] += terms.idf[c]
        dense[k] /= max(size, 1e-9) ** 0.5
    gauss = d.gaussian(terms, rank)
    assert np.allclose(got, dense.T @ (dense @ gauss), rtol=1e-2, atol=1e-2)


def brute(docs, items):
    """Every block of every document against every item, without a candidate search."""
    search = d.Search(items, None, None, None)
    mask = (1 << d.DF_BITS) - 1
    held = Counter(h for _, text in docs for h in {zlib.crc32(w) & mask for w in d.words_of(text)})
    for it in items:
        it.weights = np.array([math.log((1 + len(docs)) / (1 + held[zlib.crc32(w) & mask])) + 0.1 for w in it.words])
    out = set()
    for i, text in docs:
        words = d.words_of(text)
        for first in range(max(1, -(-len(words) // d.BLOCK_WORDS))):
            out |= {(i, it.item_id) for it in items if search.shared(words, first, it) > 0}
    return out


def items_of(rows):
    return [d.Item(i, w, w[-d.ANSWER_WORDS :]) for i, t in rows if (w := d.words_of(t))]


def found(df):
    return {(r["row"]["doc_id"], x["item_id"]) for r in df.collect() for x in r["leaks"]}


def test_table_against_all_windows(spark, data, sql, documents):
    bench = sql.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = found(d.find_leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")))
    assert got == brute([(i, t) for i, t, _ in documents], items_of(bench))
    whole = lambda t: b" " + b" ".join(d.words_of(t)) + b" "
    assert {(i, k) for i, t, _ in documents for k, b in bench if whole(b) in whole(t)} <= got


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    syllables = [c + v for c in "bcdfglmnprst" for v in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice([1, 2, 2, 3, 3])))
    text = lambda n: " ".join(word() for _ in range(n))
    return rng, text


def test_paraphrases_and_distractors(spark, corpus):
    rng, text = corpus
    bench = [(i, text(rng.randint(15, 60))) for i in range(30)]
    docs, expected = [], set()
    for k in range(60):
        docs.append((k, text(rng.randint(20, 400))))
    for k, (i, t) in enumerate(bench):
        words = t.split()
        loose = [w if rng.random() > 0.06 else text(1) for w in words]
        host = text(rng.randint(0, 200)).split()
        at = rng.randint(0, len(host))
        docs.append((100 + k, " ".join([*host[:at], " ".join(words).upper().replace(" ", ", "), *host[at:]])))
        docs.append((200 + k, " ".join([*host[:at], *loose, *host[at:]])))
        docs.append((300 + k, " ".join([*host[:at], *words[: len(words) // 3], *host[at:]])))
        expected |= {(100 + k, i)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(d.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string")))
    assert expected <= got
    assert not [x for x in got if x[0] < 100 or x[0] >= 300]
    assert len([x for x in got if 200 <= x[0] < 300]) >= 28
    assert got == brute(docs, items_of(bench))


def test_common_weight():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 9))] for _ in range(2))
        weight = dict(zip(b"abcd", [1.0, 0.5, 3.0, 2.0], strict=True))
        item = d.Item(1, a, [], np.array([weight[w[0]] for w in a]))
        best = max(sum(item.weights[list(some)]) for n in range(len(a) + 1) for some in itertools.combinations(range(len(a)), n) if naive_common([a[i] for i in some], b) == n)
        assert np.isclose(d.common_weight(item, b), best / item.weights.sum())


def test_loose_paraphrases_are_found_and_common_words_are_not(spark, corpus):
    """Items with a third of their words replaced, against documents that have just their frequent words in order."""
    rng, text = corpus
    common = [text(1) for _ in range(12)]
    mixed = lambda n, share: [rng.choice(common) if rng.random() < share else text(1) + text(1) for _ in range(n)]
    bench = [(i, " ".join(mixed(rng.randint(20, 50), 0.6))) for i in range(40)]
    docs, loose = [(k, " ".join(mixed(300, 0.6))) for k in range(200)], set()
    for i, t in bench:
        words = t.split()
        changed = set(rng.sample(range(len(words)), round(len(words) * 0.3)))
        host = mixed(120, 0.6)
        docs.append((1000 + i, " ".join([*host[:50], *(text(1) + text(2) if k in changed else w for k, w in enumerate(words)), *host[50:]])))
        docs.append((2000 + i, " ".join([*host[:50], *(w for w in words if w in common), *host[50:]])))
        loose.add((1000 + i, i))
    got = found(d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert len(loose & got) >= 36 and not got - loose
    assert got == brute(docs, items_of(bench))


def test_short_items_and_ids_that_are_no_numbers(spark):
    bench = spark.createDataFrame([("a", "silver lenka"), ("b", "moon"), ("c", "?!")], "item_id string, text string")
    df = spark.createDataFrame([(1, "the Silver, Lenka flows"), (2, "silver moons and lenka"), (3, "a moon")], "doc_id long, text string")
    assert found(d.find_leaks(df, bench)) == {(1, "a"), (3, "b")}


def test_many_items_go_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(d, "AT_A_TIME", 3)
    rng, text = corpus
    bench = [(i, text(20)) for i in range(20)]
    df = spark.createDataFrame([(i, text(30) + " " + t + " " + text(30)) for i, t in bench], "doc_id long, text string")
    assert found(d.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"))) == {(i, i) for i in range(20)}


def test_the_answer_decides_loose_matches(spark, corpus):
    item = "what river runs through the old capital of the northern province answer the silver lenka"
    loose = "they ask what river runs by the capital of that province and say the silver lenka"
    other = "they ask what river runs by the capital of that province and say nobody knows it"
    bench = spark.createDataFrame([(1, item, "silver lenka")], "item_id long, text string, answer string")
    filler = [(10 + i, "the of that and " + corpus[1](40)) for i in range(60)]
    df = spark.createDataFrame([(1, loose), (2, other), (3, item), *filler], "doc_id long, text string")
    assert found(d.find_leaks(df, bench, answer_col="answer")) == {(1, 1), (3, 1)}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (3, "too short"), (None, "a b c d e f"), (4, None)], "item_id long, text string")
    rows = [(1, "x " * 50 + "The quick brown fox jumps over the lazy dog."), (None, "the quick brown fox jumps over the lazy dog"), (2, None), (2, ""), (2, "too short"), (3, "w " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS leaks", "2 AS row")
    out = d.find_leaks(df, bench).collect()
    assert [[x["item_id"] for x in r["leaks"]] for r in out] == [[1, 2], [1, 2], [], [], [3], []]
    assert out[0]["row"].asDict().keys() == {"doc_id", "text", "leaks", "row"}
    assert [r["leaks"] for r in d.find_leaks(df, bench.limit(0)).collect()] == [[]] * 6
    assert d.find_leaks(df.limit(0), bench).collect() == []


def test_items_in_a_third_of_the_documents(spark, corpus):
    rng, text = corpus
    bench = [(i, text(rng.randint(15, 60))) for i in range(5)] + [(5, text(400))]
    docs = []
    for k in range(600):
        host = text(rng.randint(20, 700)).split()
        at = rng.randint(0, len(host))
        item = bench[0][1] if k % 3 == 0 else bench[5][1] if k % 50 == 1 else ""
        docs.append((k, " ".join([*host[:at], item, *host[at:]])))
    got = found(d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert {(k, 0) for k in range(0, 600, 3)} <= got
    assert got == brute(docs, items_of(bench))
