import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from facetloom.llm import lm_score as lm


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network(*[p.astype(np.float64) + rng.normal(size=p.shape) * 0.1 for p in lm.Network.start().parts()])
    around, names = rng.integers(0, lm.N_WORDS + 1, (12, 2 * lm.SIDE)), rng.integers(0, lm.N_WORDS, 12)
    descents, of_vectors = net.descents(around, names)
    vectors = np.zeros_like(net.vectors)
    np.add.at(vectors, around, of_vectors)
    for part, gradient in zip(net.parts(), [-vectors, *(-d for d in descents)], strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        part[at] += 1e-5
        up = net.log_probabilities(around, names).sum()
        part[at] -= 2e-5
        down = net.log_probabilities(around, names).sum()
        part[at] += 1e-5
        assert np.isclose((up - down) / 2e-5, gradient[at], rtol=1e-4, atol=1e-6)


def test_probabilities_add_up():
    net = lm.Network.start(5)
    around = np.tile([1, 2, 3, lm.EDGE], (lm.N_WORDS, 1))
    assert np.isclose(np.exp(net.log_probabilities(around, np.arange(lm.N_WORDS))).sum(), 1, atol=1e-4)


def test_scoring_holds_few_numbers_at_once():
    """The layers of one block at a time, which is what keeps scoring within the processor's cache and its budget."""
    rng = np.random.default_rng(6)
    net = lm.Network.start(1)
    around, names = rng.integers(0, lm.N_WORDS + 1, (lm.AT_ONCE, 2 * lm.SIDE)), rng.integers(0, lm.N_WORDS, lm.AT_ONCE)
    tracemalloc.start()
    got = net.log_probabilities(around, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    few = [net.log_probabilities(around[i : i + 7], names[i : i + 7]) for i in range(0, 700, 7)]
    assert np.allclose(np.concatenate(few), got[:700], rtol=1e-5)


def test_steps_of_learning():
    """Against the same steps weight by weight and example by example."""
    rng = np.random.default_rng(8)
    examples = [(rng.integers(0, 40, (n, 2 * lm.SIDE)).astype(np.uint16), rng.integers(0, lm.N_WORDS, n).astype(np.int32)) for n in (50, 50, 9)]
    net, plain = lm.Network.start(3), lm.Network(*[p.astype(np.float64) for p in lm.Network.start(3).parts()])
    assert net.learn(iter(examples)) == 109
    past = [np.full(p.shape, 1e-4) for p in plain.parts()[1:]]
    past_vectors = np.full(len(plain.vectors), 1e-4)
    for around, names in examples:
        descents, of_vectors = plain.descents(around, names)
        for p, g, s in zip(plain.parts()[1:], descents, past, strict=True):
            s += (g / len(names)) ** 2
            p -= lm.RATE * g / len(names) / np.sqrt(s)
        total = np.zeros_like(plain.vectors)
        np.add.at(total, around, of_vectors / len(names))
        past_vectors += (total**2).mean(1)
        plain.vectors -= lm.RATE * total / np.sqrt(past_vectors)[:, None]
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(net.parts(), plain.parts(), strict=True))
    assert all(np.abs(a - b).max() > 1e-3 for a, b in zip(net.parts(), lm.Network.start(3).parts(), strict=True))


def test_context_is_on_both_sides():
    vocabulary = lm.Vocabulary([b"x", b"a", b"b", b"c"])
    names = lm.names_of(lm.split_words("a b\nc"), vocabulary)
    assert names.tolist() == [1, 2, 3]
    assert lm.contexts(lm.padded(names), np.array([1])).tolist() == [[lm.EDGE, 1, 3, lm.EDGE]]
    rare = lm.names_of([b"unheard"], vocabulary)[0]
    assert lm.N_KNOWN <= rare < lm.N_WORDS


def coded(text, vocabulary):
    return lm.names_of(lm.split_words((text or "").lower()), vocabulary).astype(np.uint16).tobytes()


ODD = ["", "  ", " a  b\n", "b\x0bc\x0cd\re\t", "f\x1cg h\x85i\u00a0j", "\u00c4\u00d6 a", "a a rare words here", "x"]


@pytest.mark.parametrize("piece", [1, 20, 1 << 24])
def test_naming_and_counting_against_python(monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "N_KNOWN", 2)
    vocabulary = lm.Vocabulary([b"a", b"b", b"c", b"words"], np.array([0, 0, -5, -7]))
    texts = ODD * 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["key", "id", "text"]).slice(1)
    split = [lm.split_words(t) for t in texts[1:]]
    got = pa.Table.from_batches(lm.name_texts(iter([batch]), pa.array(list(vocabulary), pa.binary()), vocabulary.names, vocabulary.shares)).to_pydict()
    assert got["key"] == got["id"] == list(range(1, len(texts)))
    assert got["n_words"] == [len(w) for w in split]
    assert got["names"] == [lm.names_of(w, vocabulary).astype(np.uint16).tobytes() for w in split]
    assert got["share"] == [sum({b"c": -5, b"words": -7}.get(x, 0) for x in w) for w in split]
    assert got["rare"] == [[int(np.uint64(xxhash.xxh64_intdigest(x, 42)).astype(np.int64)) for x in w if x not in vocabulary] for w in split]
    counts = Counter()
    for part in lm.count_texts(iter([batch])):
        for w, n in zip(*part.to_pydict().values(), strict=True):
            counts[w.encode()] += n
    assert counts == Counter(x for w in split for x in w)
    empty = pa.Table.from_batches(lm.name_texts(iter([batch]), pa.array([], pa.binary()), lm.Vocabulary().names, lm.Vocabulary().shares)).to_pydict()
    assert empty["names"] == [lm.names_of(w, lm.Vocabulary()).astype(np.uint16).tobytes() for w in split]


def calls_of(work):
    """Functions called, those of extension modules included."""
    n = 0

    def note(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def test_naming_and_learning_take_few_operations():
    """Naming no step for each text or held word, learning few for each step, which is what keeps the query in its budget."""
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(500)])
    batch = pa.record_batch([pa.array(range(2000)), pa.array(range(2000)), pa.array([f"w{i % 500} w7 w{i % 77}" for i in range(2000)])], names=["key", "id", "text"])
    words = pa.array(list(vocabulary), pa.binary())
    assert calls_of(lambda: list(lm.name_texts(iter([batch]), words, vocabulary.names, vocabulary.shares))) < 1000
    rng = np.random.default_rng(4)
    around, names = rng.integers(0, lm.N_WORDS, (lm.STEP, 2 * lm.SIDE)).astype(np.uint16), rng.integers(0, lm.N_WORDS, lm.STEP).astype(np.int32)
    net, gradients = lm.Network.start(), [np.empty_like(p) for p in lm.Network.start().parts()[1:]]
    got, of_vectors = net.descents(around, names, 0.5, gradients)
    plain, plain_vectors = net.descents(around, names)
    assert all(a is b for a, b in zip(got, gradients, strict=True))  # no copies into one array
    assert all(np.allclose(2 * a, b, atol=1e-4) for a, b in zip([*got, of_vectors], [*plain, plain_vectors], strict=True))


def test_logits_are_bounded():
    net = lm.Network.start()
    around, names = np.tile([1, 2, 3, lm.EDGE], (64, 1)), np.arange(64)
    for part in (net.group, net.place, net.group_bias, net.place_bias):
        kept = part.copy()
        part[..., 3] += 1000
        assert np.isfinite(net.log_probabilities(around, names)).all()
        assert all(np.isfinite(d).all() for d in net.descents(around, names)[0])
        part[:] = kept


def test_every_word_is_an_example():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.N_WORDS, n).astype(np.uint16) for n in [3, 0, 1, 700, lm.AT_ONCE + 300, 20, 5000]]
    got = [np.concatenate(x) for x in zip(*lm.steps(t.tobytes() for t in texts), strict=True)]
    rows = [lm.padded(t) for t in texts]
    assert np.array_equal(got[1], np.concatenate(texts))
    assert np.array_equal(got[0], np.concatenate([lm.contexts(r, np.arange(len(t))) for r, t in zip(rows, texts, strict=True)]))
    assert all(len(n) <= lm.STEP for _, n in lm.steps(t.tobytes() for t in texts))


def test_scores_by_place_and_packing():
    net = lm.Network.unpacked(lm.Network.start(2).packed())
    vocabulary = lm.Vocabulary([w.encode() for w in "the of and to in".split()])
    texts = ["the of and", None, "", "to in " * (lm.AT_ONCE // 2 + 50), "the of and", "x"]
    sums = lm.score_names([coded(t, vocabulary) for t in texts], net)
    for text, s in zip(texts, sums, strict=True):
        names = np.frombuffer(coded(text, vocabulary), np.uint16).astype(np.int32)
        n = len(names)
        alone = net.log_probabilities(lm.contexts(lm.padded(names), np.arange(n)), names).sum() if n else 0.0
        assert np.isclose(s, alone, rtol=1e-4)
    assert sums[0] == sums[4]


def test_learning_a_pattern(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    follow = dict(zip(words, rng.permutation(words), strict=True))

    def text():
        out = [str(rng.choice(words))]
        for _ in range(199):
            out.append(follow[out[-1]] if rng.random() < 0.9 else str(rng.choice(words)))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string").repartition(3)
    model = lm.train(docs, learners=3, rounds=3)
    vocabulary, net = model.vocabulary, model.network
    plain, mixed = text(), " ".join(rng.choice(words, 200))
    sums = lm.score_names([coded(plain, vocabulary), coded(mixed, vocabulary)], net)
    assert sums[0] / 200 > sums[1] / 200 + 0.5
    assert sums[0] / 200 > -np.log(30)
    again = lm.train(docs.repartition(5), learners=3, rounds=3).network  # other files, same weights
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(net.parts(), again.parts(), strict=True))


def test_rows(spark):
    rows = [(1, "the cat sat"), (None, "the cat sat"), (2, None), (2, ""), (3, "a " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS id")
    got = sorted(lm.score_corpus(docs).collect(), key=lambda r: (r["id"] is None, r["id"] or 0))
    assert [(r["id"], r["n_words"]) for r in got] == [(1, 3), (2, 0), (2, 0), (3, 30_000), (None, 3)]
    assert np.isclose(got[0]["log_probability"], got[4]["log_probability"], rtol=1e-6) and got[0]["log_probability"] < 0
    assert got[1]["log_probability"] == 0.0 == got[1]["mean_log_probability"]
    empty = docs.limit(0)
    assert lm.score_corpus(empty).collect() == []
    model = lm.train(empty)
    assert lm.scored(lm.encode(docs, model.vocabulary), model).count() == 5
    named = docs.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert {r["id"] for r in lm.score_corpus(named).collect()} == {"1", "2", "3", None}


@pytest.mark.parametrize("held", [300, 1 << 16])
def test_words_that_share_a_place_have_their_own_probability(spark, monkeypatch, held):
    """The query against sums made word by word; few words have places of their own, and few or all are held by tasks."""
    monkeypatch.setattr(lm, "RARE_GROUPS", 62)
    monkeypatch.setattr(lm, "N_KNOWN", 128)
    monkeypatch.setattr(lm, "HELD", held)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (1 + i) for i in range(3000)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 300))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs, learners=2)
    counts = Counter(w for t in texts for w in t.split())
    known = sorted(counts, key=lambda w: (-counts[w], w))[: lm.N_KNOWN]
    assert {w.encode() for w in known} == {w for w, i in model.vocabulary.items() if i < lm.N_KNOWN} and len(model.vocabulary) <= held
    place = lambda w: zlib.crc32(w.encode()) % (lm.N_WORDS - 128)
    first, shared = set(known), Counter()
    for w in set(counts) - set(known):
        shared[place(w)] += counts[w]
    assert shared and len(counts) > lm.N_KNOWN
    got = {r["id"]: r["log_probability"] for r in lm.scored(lm.encode(docs, model.vocabulary), model).collect()}
    for i, t in enumerate(texts):
        own = lm.score_names([coded(t, model.vocabulary)], model.network)[0]
        own += sum(math.log(counts[w] / shared[place(w)]) for w in t.split() if w not in first)
        assert np.isclose(got[i], own, rtol=1e-4, atol=1e-3)


def test_better_than_word_frequencies_on_held_out_text(spark, data):
    """Trained on four fifths of the documents, the rest is likelier than by the frequencies of words."""
    docs = spark.read.parquet(f"{data.replace("sf0.001", "sf0.01")}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    train, rest = docs.filter("crc32(text) % 5 > 0"), docs.filter("crc32(text) % 5 = 0")
    model = lm.train(train, learners=1, rounds=4)
    counts = Counter(w for r in train.collect() for w in (r["text"] or "").lower().split())
    total = sum(counts.values()) + 1
    unheard = 0.5 / total
    frequencies = n = 0
    for r in rest.collect():
        for w in (r["text"] or "").lower().split():
            frequencies += math.log(counts[w] / total) if w in counts else math.log(unheard)
            n += 1
    got = lm.scored(lm.encode(rest, model.vocabulary), model).agg({"log_probability": "sum", "n_words": "sum"}).first()
    assert got["sum(n_words)"] == n

    print(got["sum(log_probability)"] / n, frequencies / n)
    assert got["sum(log_probability)"] / n > frequencies / n + 0.1
