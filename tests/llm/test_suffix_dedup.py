import random

import numpy as np
import pytest

from facetloom.llm import suffix_dedup as s


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def rows_of(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([60, 120, 400]))) for _ in range(8)]
    rows = [(None, "x" * 200), (None, base[0]), (5, None), (5, ""), (7, "a" * 49), (8, "a" * 50), (9, "a" * 51), (3, "a" * 300), (11, "ab" * 100), (2, "ba" * 60)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            parts += [b[at : at + rng.randint(10, 200)], "".join(rng.choice("abcdefé") for _ in range(rng.randint(0, 40)))]
        rows.append((rng.choice([i + 20, i + 20, i + 19]), "".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(0, 1000), (1, 1000), (0, 3), (1, 1)])
def test_against_all_strings(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(s.answer_hashes, "__defaults__", (hot,))
    monkeypatch.setattr(s, "SHARD_BYTES", 2000)
    monkeypatch.setattr(s, "BUCKET_BYTES", 1500)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS shard", "'x' AS kept", "2 AS n_bytes")
    got = sorted([tuple(r) for r in s.dedup_digests(df).collect()], key=key)
    assert got == sorted(s.brute_force(rows), key=key)


def test_table_against_all_strings(spark, data, documents):
    got = sorted(tuple(r) for r in s.dedup_digests(spark.read.parquet(f"{data}/documents.parquet")).collect())
    assert got == sorted(s.brute_force([(i, t) for i, t, _ in documents]))
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("shards_")]


def test_a_passage_in_every_document(spark):
    rng = random.Random(3)
    passage = "this very passage of more than fifty bytes stands in each and every one of the documents"
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(80)) + passage + "".join(rng.choice("klmnop ") for _ in range(80))) for i in range(400)]
    got = sorted(tuple(r) for r in s.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted(s.brute_force(rows))
    assert got[0][2] == 0 and all(r[2] >= len(passage) and r[3] == 1 for r in got[1:])


def test_the_merged_transforms_decide(spark, data, monkeypatch):
    """Without the interleave nothing is found to be repeated, copies inside a shard and whole documents included."""
    monkeypatch.setattr(s, "interleave", lambda parts, rows, length: (rows[:0], rows[:0]))
    got = s.dedup_digests(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert got and all(r["n_removed"] == 0 for r in got)


def test_ids_of_any_type(spark):
    rows = [("b", "x" * 60), ("a", "y" + "x" * 60), (None, "x" * 60), ("c", "clean")]
    got = {r[0]: r[2] for r in s.dedup_digests(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 60, None: 60, "c": 0}


def test_a_failed_run_leaves_no_table(spark, monkeypatch):
    monkeypatch.setattr(s, "send_hashes", lambda batches, bits: 1 / 0)
    with pytest.raises(Exception):  # noqa: B017
        s.dedup_digests(spark.createDataFrame([(1, "x" * 60)], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shards_")]


def test_kept_text_can_be_read(spark):
    rows = [(1, "é" * 60), (2, "start " + "é" * 60 + " end")]
    found = s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    kept = {r["id"]: bytes(r["kept"]).decode() for r in found.rows.collect()}
    found.drop()
    assert kept == {1: "é" * 60, 2: "start  end"}


def test_empty_table(spark):
    assert s.dedup_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_of_equal_strings_are_equal(monkeypatch):
    monkeypatch.setattr(s, "STRETCH", 64)
    rng = random.Random(4)
    common = bytes(rng.choice(b"abcd") for _ in range(300))
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90))) + common + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90))) for _ in range(2)]
    found = []
    for t in texts:
        own = s.Shard(np.array([1], np.int64).tobytes(), np.array([len(t)], np.int64).tobytes(), t)
        assert sum((own.last - own.first + 1).tolist()) == len(t) - s.LENGTH + 1
        at = t.index(common)
        hashes = np.repeat(own.hash, own.last - own.first + 1)
        found.append(hashes[at : at + len(common) - s.LENGTH + 1].tolist())
    assert found[0] == found[1]


def test_transform_is_that_of_sorted_rings():
    pieces = [b"banana", b"ananas", b"bandana"]
    t = s.Transform(pieces, 0)
    whole = b"".join(p + b"\xff" for p in pieces)
    rings = []
    for p in pieces:
        ring = p + b"\xff"
        rings += [(ring[i:] + ring[:i], at) for i, at in zip(range(len(ring)), range(whole.index(ring), whole.index(ring) + len(ring)), strict=True)]
    assert t.suffixes.tolist() == [at for _, at in sorted(rings)]
    assert [int(x) for x in t.symbols] == [(r[-2] << 8) | r[-1] for r, _ in sorted(rings)]
    assert (t.row_of[t.suffixes] == np.arange(len(whole))).all()


@pytest.mark.parametrize("symbols", [20, 1 << 18])
def test_merged_intervals(symbols):
    rng = random.Random(symbols)
    pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 14))) for _ in range(60)})
    ids = np.array([rng.randint(0, 30) for _ in pieces])
    least = {}
    for p, i in zip(pieces, ids.tolist(), strict=True):
        for at in range(len(p) - 7):
            least[p[at : at + 8]] = min(i, least.get(p[at : at + 8], i))
    for twice in (0, 1, 17, len(pieces)):
        again = np.concatenate([ids, ids[:twice]])
        check_intervals(pieces + pieces[:twice], s.smallest_ids(pieces, again, 8, symbols, twice), least)


def check_intervals(pieces, found, least):
    assert len(found.first) == len(pieces) + 1
    for k, p in enumerate(pieces):
        runs = slice(found.first[k], found.first[k + 1])
        assert np.repeat(found.ids[runs], found.sizes[runs]).tolist() == [least[p[at : at + 8]] for at in range(len(p) - 7)]
