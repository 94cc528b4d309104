"""Suffix-array dedup by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document
with a smaller id.  Four steps find those strings exactly:

1. Documents are packed into shards and written once, bucketed by shard, so that no
   later step moves their text again.
2. Every string of ``LENGTH`` bytes has an anchor, the place in it where a hash of
   ``ANCHOR`` bytes is least.  Equal strings have equal anchors, so a string can only
   repeat if its anchor's hash does.  Shards send the hashes, 5 bytes for each distinct
   one, and get back whether it occurs elsewhere and whether it is hot.
3. Runs of strings with a repeated anchor become fragments: the text they span, once
   for each shard, with the smallest id that has it there.  Fragments meet by anchor;
   those of a hot anchor are split into single strings that meet by their own hash, so
   the many surroundings of one frequent passage are spread over all buckets.  Of equal
   fragments one stands for the smallest id and one for all others; that they are equal,
   and which id the others learn of, comes from the merged transforms alone.  The fragments of some shards at a time get a suffix array and a
   Burrows-Wheeler transform, and the transforms are merged by refining their
   interleave, two symbols at a time: a stable sort of the interleaved preceding symbols
   orders the suffixes by two symbols more.  No suffix is compared or sorted again.
   Along the way the places where neighbours stop sharing a prefix are kept; those that
   share ``LENGTH`` symbols are a repeated interval, and its smallest id goes back to
   the shards.
4. Shards mark and cut the covered bytes.

Defined results: a null text is empty; rows with the same id do not count as smaller
than each other; null ids count as larger than all others and never remove anything
from each other.  Ids may have any type that sorts.  An empty table gives an empty table.

A task holds one shard, or the fragments of one bucket.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

LENGTH = 50
#: Bytes that an anchor's hash covers.
ANCHOR = 24
#: Bytes of text in a shard and behind a bucket of anchors; a longer document is a shard of its own.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Tasks that buckets, or shards, are dealt to; there may be more of either.
MOST_TASKS = 1 << 15
#: Runs with the same anchor from which on it is hot.
HOT_RUNS = 1000
#: Starts whose anchors are sought at once.
STRETCH = 1 << 19
#: Symbols of the fragments whose suffixes are sorted as one shard's; their ranks are numbers of 16 bits.
TRANSFORM_SYMBOLS = 1 << 16
#: Bits of an anchor's value by which a bucket's fragments are merged apart, so that a merge stays in the processor's cache.
PART_BITS = 4
#: The id that null stands for, and the byte that ends a fragment: no UTF-8 text has it.
NO_ID, END = (1 << 63) - 1, 0xFF

SHARD_SCHEMA = "shard long, n_bytes long, ids binary, nulls binary, lens binary, text binary"


def pack(batches: Iterator[pa.RecordBatch], size: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) as shards; a shard is one row."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    ids: list = []
    texts: list[bytes] = []
    held = made = 0

    def shard() -> pa.RecordBatch:
        nulls = np.array([i is None for i in ids])
        numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
        lens = np.array([len(t) for t in texts], np.int64)
        cells = [first + made, int(lens.sum()), numbers.tobytes(), nulls.tobytes(), lens.tobytes(), b"".join(texts)]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["shard", "n_bytes", "ids", "nulls", "lens", "text"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or b""
            if texts and held + len(t) > size:
                yield shard()
                made, held, ids, texts = made + 1, 0, [], []
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield shard()


def least_ahead(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive keys, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def hashes_at(text: bytes, at: int, places: slice | np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place (counted from ``at``) on; ``text`` is eight bytes longer than it needs to be."""
    words = np.ndarray((len(text) - at - 7,), "<u8", text, at, (1,))
    shifted = lambda o: slice(places.start + o, places.stop + o) if isinstance(places, slice) else places + o
    h = words[places] * np.uint64(0x9E3779B97F4A7C15)
    for o in [*range(8, width - 8, 8), width - 8]:
        h ^= h >> np.uint64(31)
        h += words[shifted(o)]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Shard:
    """A shard's documents and its runs: successive strings with the same anchor."""

    def __init__(self, ids: bytes, lens: bytes, text: bytes, length: int = LENGTH, anchor: int = ANCHOR):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.text, self.length = text, length
        self.ends = np.cumsum(self.lens)
        firsts, lasts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        window = length - anchor + 1
        padded = text + bytes(8)
        bits = np.uint64(max(1, (STRETCH + window).bit_length()))
        for at in range(0, max(0, len(text) - length + 1), STRETCH):
            n = min(STRETCH, len(text) - length + 1 - at)
            h = hashes_at(padded, at, slice(0, n + window - 1), anchor)
            # The least hash, and of equal ones the first, in one number.
            keys = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
            place = (least_ahead(keys, window) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            whole = np.ones(n, bool)
            inner = self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, at + n + length)] - at
            for e in inner.tolist():  # strings that would reach over a document's end
                whole[max(0, e - length + 1) : max(0, e)] = False
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            turn = np.flatnonzero((np.diff(place[starts]) != 0) | (np.diff(starts) != 1))
            first, last = starts[np.r_[0, turn + 1]], starts[np.r_[turn, len(starts) - 1]]
            firsts.append(first + at)
            lasts.append(last + at)
            hashes.append(h[place[first]])
        self.first, self.last, self.hash = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def values(self, bucket_bits: int) -> np.ndarray:
        """What is sent of the anchors' hashes: bucket bits, then 32 more, stirred again since anchors have the least hashes."""
        h = self.hash * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h >> np.uint64(32 - bucket_bits)

    def shared(self, bucket_bits: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs whose anchor occurs elsewhere, their values, and which of them are hot."""
        values = self.values(bucket_bits)
        distinct, which = np.unique(values, return_inverse=True)
        buckets = (distinct >> np.uint64(32)).astype(np.int64)
        bits = np.zeros((2, len(distinct)), bool)
        for bucket, answer in answers.items():
            lo, hi = np.searchsorted(buckets, [bucket, bucket + 1])
            half = len(answer) // 2
            for i in range(2):
                bits[i, lo:hi] = np.unpackbits(np.frombuffer(answer, np.uint8, half, i * half), count=hi - lo).astype(bool)
        runs = np.flatnonzero(bits[0][which])
        return runs, values[runs], bits[1][which[runs]]

    def fragments(self, bucket_bits: int, answers: dict[int, bytes]) -> Fragments:
        """What the shard's runs with a shared anchor span, in order of value; hot ones string by string."""
        runs, values, hot = self.shared(bucket_bits, answers)
        first, last = self.first[runs], self.last[runs]
        n = (last - first + 1)[hot]
        single = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = hashes_at(self.text + bytes(8), 0, single, self.length) >> np.uint64(32 - bucket_bits) if len(single) else values[:0]
        first, last = np.concatenate([first[~hot], single]), np.concatenate([last[~hot], single])
        values = np.concatenate([values[~hot], own])
        doc = np.concatenate([self.doc[runs[~hot]], np.repeat(self.doc[runs[hot]], n)])
        order = np.argsort(values, kind="stable")
        first, last, values, doc = first[order], last[order], values[order], doc[order]
        # Only runs of the same value can span equal text; of equal ones the first stands for all.
        n, stands = len(first), np.arange(len(first))
        again = np.concatenate([[False], values[1:] == values[:-1]])[:n]
        twins = np.flatnonzero(again | np.append(again[1:], False)[:n])
        text, places = self.text, {}
        spans = zip(twins.tolist(), first[twins].tolist(), (last[twins] + self.length).tolist(), strict=True)
        stands[twins] = [places.setdefault(text[a:b], i) for i, a, b in spans]
        heads = np.flatnonzero(stands == np.arange(n))
        kind = np.searchsorted(heads, stands)
        least = np.full(len(heads), NO_ID, np.int64)
        np.minimum.at(least, kind, self.ids[doc])
        more = np.zeros(len(heads), bool)
        more[kind[self.ids[doc] > least[kind]]] = True
        return Fragments(first, doc, kind, values[heads], first[heads], last[heads] + self.length, least, more)


class Fragments(NamedTuple):
    """Where a shard's fragments stand (start, document, number of the fragment), and what they are.

    That is their value, span and smallest id, and whether the shard has them with larger ids too.
    """

    first: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    values: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    least: np.ndarray
    more: np.ndarray


def send_hashes(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, shard, values, counts): the distinct anchor hashes of a shard, and how often it has each, up to 255."""
    for shard, own in shards_of(batches):
        distinct, counts = np.unique(own.values(bucket_bits), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        yield dealt(shard, distinct, lambda lo, hi: (distinct[lo:hi].astype(np.uint32).tobytes(), counts[lo:hi].tobytes()), ["values", "counts"])  # noqa: B023


def dealt(shard: int, ascending: np.ndarray, payload, names: list[str]) -> pa.RecordBatch:
    """A row of ``payload`` for each bucket of the ascending values."""
    buckets = (ascending >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(buckets) else np.zeros(1, np.int64)
    rows = [(int(buckets[lo]), shard, *payload(lo, hi)) for lo, hi in itertools.pairwise(edges.tolist())]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(2 + len(names))]
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]]
    return pa.record_batch(arrays, names=["bucket", "shard", *names])


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for shard, ids, lens, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "lens", "text")), strict=True):
            yield shard, Shard(ids, lens, text)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket; they come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def answer_hashes(batches: Iterator[pa.RecordBatch], hot_runs: int = HOT_RUNS) -> Iterator[pa.RecordBatch]:
    """(shard, kind, bucket, data): for each hash that a shard sent, a bit if it has another place, and then a bit if it is hot."""
    for bucket, rows in by_bucket(batches):
        sent = [np.frombuffer(v, np.uint32) for _, v, _ in rows]
        counts = np.frombuffer(b"".join([c for _, _, c in rows]), np.uint8)
        _, which = np.unique(np.concatenate(sent), return_inverse=True)
        runs = np.bincount(which, counts)[which]
        edges = np.cumsum([0, *map(len, sent)])
        answers = [np.packbits(runs[a:b] > 1).tobytes() + np.packbits(runs[a:b] >= hot_runs).tobytes() for a, b in itertools.pairwise(edges.tolist())]
        yield answer_rows(bucket, "anchor", [s for s, _, _ in rows], answers)


def answer_rows(bucket: int, kind: str, shards: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(shards)
    return pa.record_batch([pa.array(shards, pa.int64()), pa.array([kind] * n), pa.array([bucket] * n, pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "bucket", "data"])


ANSWER_SCHEMA = "shard long, kind string, bucket int, data binary"


def answers_of(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {b: d for k, b, d in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True) if k == kind}


def send_fragments(shards: pa.Table, answers: pa.Table, bucket_bits: int) -> pa.Table:
    """(bucket, shard, ids, more, lens, parts, text): a shard's fragments, and where each part of them ends."""
    out = []
    for shard, own in shards_of(shards.to_batches()):
        found = own.fragments(bucket_bits, answers_of(answers, "anchor"))

        def payload(lo: int, hi: int, text: bytes = own.text, found: Fragments = found) -> tuple:
            begin, end = found.begin[lo:hi], found.end[lo:hi]
            low = found.values[lo:hi] & np.uint64(0xFFFFFFFF)
            parts = np.searchsorted(low >> np.uint64(32 - PART_BITS), np.arange(1 << PART_BITS), "right").astype(np.int32)
            pieces = b"".join([text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            return (found.least[lo:hi].tobytes(), found.more[lo:hi].tobytes(), (end - begin).astype(np.uint8).tobytes(), parts.tobytes(), pa.compress(pieces, "zstd", asbytes=True))

        out.append(dealt(shard, found.values, payload, ["ids", "more", "lens", "parts", "text"]))
    return pa.Table.from_batches(out, FRAGMENTS) if out else FRAGMENTS.empty_table()


FRAGMENTS = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), *[(n, pa.binary()) for n in ("ids", "more", "lens", "parts", "text")]])
FRAGMENT_SCHEMA = "bucket int, shard long, ids binary, more binary, lens binary, parts binary, text binary"


class Transform:
    """The suffixes of some fragments, sorted, with the two symbols before each and where that leads.

    Fragments are read as rings closed by END, so every suffix has symbols before it.
    """

    def __init__(self, pieces: list[bytes], base: int):
        self.base = base  # of its symbols among those of all transforms
        ended = np.frombuffer(b"".join([p + b"\xff" for p in pieces]), np.uint8)
        n = len(ended)
        stops = np.flatnonzero(ended == END)
        begins = np.r_[0, stops[:-1] + 1]
        after = np.arange(1, n + 1)
        after[stops] = begins
        before = np.arange(-1, n - 1)
        before[begins] = stops
        # Eight symbols in a number; then the rank of four times as many, from four ranks of 16 bits.
        key, at = np.zeros(n, np.uint64), np.arange(n)
        for _ in range(8):
            key = (key << np.uint64(8)) | ended[at]
            at = after[at]
        rank, span, longest = ranked(key), 8, int((stops - begins).max(initial=0)) + 1
        while span < longest and int(rank.max(initial=0)) + 1 < n:
            wide, second = rank.astype(np.uint64), at[at]
            rank = ranked(wide << np.uint64(48) | wide[at] << np.uint64(32) | wide[second] << np.uint64(16) | wide[second[at]])
            at, span = second[second], span * 4
        self.suffixes = np.argsort(rank).astype(np.int32)
        self.row_of = np.empty(n, np.int32)
        self.row_of[self.suffixes] = np.arange(n, dtype=np.int32)
        back = before[before]
        pair = (ended[back].astype(np.uint16) << np.uint16(8)) | ended[before]
        self.symbols = pair[self.suffixes]
        self.leads = self.row_of[back[self.suffixes]]

    def again(self, base: int) -> Transform:
        """The transform of the same fragments at another place."""
        out = object.__new__(Transform)
        out.__dict__.update(self.__dict__, base=base)
        return out


def ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]][: len(key)], dtype=np.int32)
    return rank


def interleave(parts: list[Transform], rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval) of the suffixes ``length`` symbols before those of ``rows``, equal intervals for equal first ``length`` symbols.

    ``rows`` come in the order of the transforms laid end to end, the first interleave.
    A suffix that has become the only one of its interval stays so, as do those before
    it; it leaves the interleave and is not returned.
    """
    symbols = np.concatenate([p.symbols for p in parts])
    leads = np.concatenate([p.leads + np.int32(p.base) for p in parts])
    interval = np.zeros(len(rows), np.int32)
    for turn in range(length // 2):
        before = symbols[rows]
        order = np.argsort(before, kind="stable")
        before, inherited = before[order], interval[order]
        rows = leads[rows[order]]
        # Suffixes part where the two symbols before them differ, or what follows had parted.
        parted = (before[1:] != before[:-1]) | (inherited[1:] != inherited[:-1])
        interval = np.cumsum(np.concatenate([[False], parted]), dtype=np.int32)
        if turn % 4 == 3 or turn == length // 2 - 1:
            alone = np.concatenate([[True], parted]) & np.concatenate([parted, [True]])
            rows, interval = rows[~alone], interval[~alone]
            if not len(rows):
                break
    return rows, interval


class Replies(NamedTuple):
    """For fragments in order: runs of starts with the same smallest id."""

    first: np.ndarray  # run of each fragment, and one more
    sizes: np.ndarray
    ids: np.ndarray


def smallest_ids(pieces: list[bytes], ids: np.ndarray, length: int, symbols: int = TRANSFORM_SYMBOLS, twice: int = 0) -> Replies:
    """For each start of each fragment, the smallest id of a fragment with the same string of ``length`` bytes.

    The first ``twice`` fragments come again at the end, with the last ``twice`` ids; equal shards have equal transforms.
    """
    parts, some, held, base, n_twice = [], [], 0, 0, 0
    for at, p in enumerate(pieces):
        if some and (at == twice or held + len(p) + 1 > min(symbols, TRANSFORM_SYMBOLS)):
            parts.append(Transform(some, base))
            base, some, held = base + held, [], 0
        n_twice = len(parts) if at == twice else n_twice
        some.append(p)
        held += len(p) + 1
    parts.append(Transform(some, base))
    n_twice = len(parts) if twice == len(pieces) else n_twice
    parts += [p.again(base + held + p.base) for p in parts[:n_twice]]
    pieces = pieces + pieces[:twice]
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = lens - length + 1
    total = np.cumsum(starts) - starts
    # Each start's place among all symbols; the refinement sets out from where its string ends.
    place = np.repeat(np.cumsum(lens + 1) - (lens + 1) - total, starts) + np.arange(int(starts.sum()))
    row_of = np.concatenate([p.row_of + np.int32(p.base) for p in parts])
    suffixes = np.concatenate([p.suffixes + np.int32(p.base) for p in parts])
    rows, interval = interleave(parts, np.sort(row_of[place + length]), length)
    owner = np.repeat(np.arange(len(pieces)), starts)
    found = ids[owner]
    if len(rows):
        start_at = np.zeros(len(row_of), np.int32)
        start_at[place] = np.arange(len(place), dtype=np.int32)
        which = start_at[suffixes[rows]]
        edges = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        least = np.minimum.reduceat(found[which], edges)
        found[which] = np.repeat(least, np.diff(np.append(edges, len(which))))
    runs = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])]))
    return Replies(np.searchsorted(owner[runs], np.arange(len(pieces) + 1)), np.diff(np.append(runs, len(found))), found[runs])


class Sent(NamedTuple):
    """A shard's fragments of one part of a bucket, and the number of the first among its fragments of the bucket."""

    at: int
    pieces: list[bytes]
    ids: np.ndarray
    more: np.ndarray


def parts_of(ids: bytes, more: bytes, lens: bytes, parts: bytes, text: bytes) -> Iterator[Sent]:
    """What a shard sent to a bucket, part by part."""
    edges = np.cumsum(np.r_[0, np.frombuffer(lens, np.uint8)].astype(np.int64)).tolist()
    text = pa.decompress(text, edges[-1], "zstd", asbytes=True)
    for a, b in itertools.pairwise([0, *np.frombuffer(parts, np.int32).tolist()]):
        pieces = [text[i:j] for i, j in itertools.pairwise(edges[a : b + 1])]
        yield Sent(a, pieces, np.frombuffer(ids, np.int64)[a:b], np.frombuffer(more, bool)[a:b])


def answer_fragments(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(shard, kind, bucket, data): the smallest id for the strings of each fragment, as runs of (fragment, starts, id).

    Equal strings have equal values, so the parts of a bucket are merged one after the other.
    """
    for bucket, rows in by_bucket(batches):
        answers = [answer_part(list(sent), length) for sent in zip(*(parts_of(*r[1:]) for r in rows), strict=True)]
        data = [b"".join(np.concatenate(column).tobytes() for column in zip(*of_shard, strict=True)) for of_shard in zip(*answers, strict=True)]
        yield answer_rows(bucket, "fragment", [r[0] for r in rows], data)


def answer_part(shards: list[Sent], length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard the runs (fragment, starts, smallest id) of its fragments that some smaller id has."""
    places: dict[bytes, int] = {}
    wheres = [np.fromiter((places.setdefault(p, len(places)) for p in sent.pieces), np.int64, len(sent.pieces)) for sent in shards]
    pieces = list(places)
    if not pieces:
        return [(np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64))] * len(shards)
    least, holders = np.full(len(pieces), NO_ID, np.int64), np.zeros(len(pieces), np.int64)
    for where, sent in zip(wheres, shards, strict=True):
        np.minimum.at(least, where, sent.ids)
        np.add.at(holders, where, 1 + sent.more)
    # A second copy stands for those that do not have the smallest id; the merge tells them of it.
    order = np.argsort(holders <= 1, kind="stable")  # those that come twice are first
    twice = int((holders > 1).sum())
    stands = np.empty(len(pieces), np.int64)
    stands[order] = np.r_[len(pieces) : len(pieces) + twice, twice : len(pieces)]
    merged = smallest_ids([pieces[i] for i in order.tolist()], np.concatenate([least[order], np.full(twice, NO_ID, np.int64)]), length, twice=twice)
    first, n_runs = merged.first[:-1], np.diff(merged.first)
    least = merged.ids[first]  # that of a fragment's first start, and of all if it has one run
    out = []
    for where, sent in zip(wheres, shards, strict=True):
        where = stands[where]
        # Fragments that no larger id has need no reply.
        split = n_runs[where] > 1
        simple = np.flatnonzero(((least[where] < sent.ids) | sent.more) & ~split)
        several = np.flatnonzero(split)
        n = n_runs[where[several]]
        along = np.repeat(first[where[several]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        fragment = (np.concatenate([simple, np.repeat(several, n)]) + sent.at).astype(np.int32)
        size = np.concatenate([np.full(len(simple), 255), merged.sizes[along]]).astype(np.uint8)
        out.append((fragment, size, np.concatenate([least[where[simple]], merged.ids[along]]).astype(np.int64)))
    return out


def cut_shards(shards: pa.Table, answers: pa.Table, bucket_bits: int, length: int = LENGTH) -> pa.Table:
    """(id, n_bytes, n_removed, n_spans, kept) for the documents of a shard."""
    out: list[pa.RecordBatch] = []
    for at, (_, own) in enumerate(shards_of(shards.to_batches())):
        covered = cover(own, own.fragments(bucket_bits, answers_of(answers, "anchor")), answers_of(answers, "fragment"), length)
        raw = np.frombuffer(own.text, np.uint8)
        begins = own.ends - own.lens
        sums = np.concatenate([[0], np.cumsum(covered, dtype=np.int32)])
        removed = sums[own.ends] - sums[begins]
        rises = covered & ~np.r_[False, covered[:-1]]
        rises[begins[(own.lens > 0)]] = covered[begins[own.lens > 0]]
        starts = np.concatenate([[0], np.cumsum(rises, dtype=np.int32)])
        spans = starts[own.ends] - starts[begins]
        kept = [own.text[a:b] if not r else raw[a:b][~covered[a:b]].tobytes() for a, b, r in zip(begins.tolist(), own.ends.tolist(), removed.tolist(), strict=True)]
        nulls = np.frombuffer(shards.column("nulls")[at].as_py(), bool)
        ids = pa.array(own.ids, mask=nulls)
        out.append(pa.record_batch([ids, pa.array(own.lens), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]))
    return pa.Table.from_batches(out, CUT) if out else CUT.empty_table()


CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
CUT_SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cover(own: Shard, found: Fragments, replies: dict[int, bytes], length: int) -> np.ndarray:
    """Which bytes of a shard a string covers that also starts in a document with a smaller id."""
    starts_of = found.end - found.begin - length + 1
    offsets = np.r_[0, np.cumsum(starts_of)]
    least = np.full(int(starts_of.sum()), NO_ID, np.int64)  # until a reply names a smaller one
    buckets = (found.values >> np.uint64(32)).astype(np.int64)
    for bucket, data in replies.items():
        n = len(data) // 13
        which, sizes = np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64)
        ids = np.frombuffer(data, np.int64, n, 5 * n) if 5 * n % 8 == 0 else np.frombuffer(data[5 * n :], np.int64, n)
        at = which + np.searchsorted(buckets, bucket)
        sizes = np.where(sizes == 255, starts_of[at], sizes)
        # Runs of one fragment follow each other from its first start on.
        fresh = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if n else np.zeros(0, np.int64)
        total = np.cumsum(sizes) - sizes
        within = total - np.repeat(total[fresh], np.diff(np.r_[fresh, n])) if n else total
        place = np.repeat(offsets[at] + within - total, sizes) + np.arange(int(sizes.sum()))
        least[place] = np.repeat(ids, sizes)
    change = np.zeros(len(own.text) + 1, np.int32)
    sizes = starts_of[found.kind]
    step = 1 << 16
    for lo in range(0, len(sizes), step):
        f, first, n = found.kind[lo : lo + step], found.first[lo : lo + step], sizes[lo : lo + step]
        total = np.cumsum(n) - n
        along = np.arange(int(n.sum()))
        small = least[np.repeat(offsets[f] - total, n) + along] < np.repeat(own.ids[found.doc[lo : lo + step]], n)
        at = (np.repeat(first - total, n) + along)[small]
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


class Found(NamedTuple):
    """What is left of each row, and the table in the warehouse that it is computed from."""

    rows: DataFrame
    table: str

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Found:
    """(id, n_bytes, n_removed, n_spans, kept): every row of ``df`` and the bytes that stay.

    The bucketed copy of the texts is a table of the session's warehouse; drop it when
    the rows have been used.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    numbers = None if isinstance(docs.schema["id"].dataType, T.IntegralType) else numbered(docs)
    if numbers is not None:
        docs = docs.join(numbers, "id", "left").select(F.col("number").alias("id"), "text")
    name = f"shards_{uuid.uuid4().hex}"
    try:
        rows = from_shards(docs.withColumn("id", F.col("id").cast("long")), name)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    if numbers is not None:
        rows = rows.withColumnRenamed("id", "number").join(numbers, "number", "left").select("id", "n_bytes", "n_removed", "n_spans", "kept")
    return Found(rows, name)


def numbered(docs: DataFrame) -> DataFrame:
    """(id, number): the distinct ids, numbered in their order."""
    return cut(docs.select("id").filter("id IS NOT NULL").distinct().sort("id").withColumn("number", F.monotonically_increasing_id()))


def from_shards(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``repeated_spans``, whose shards are the table ``name``."""
    spark = docs.sparkSession
    buckets_of_shards = min(MOST_TASKS, max(1, docs.rdd.getNumPartitions()))
    packed = docs.mapInArrow(pack, SHARD_SCHEMA)
    packed.write.bucketBy(buckets_of_shards, "shard").option("compression", "zstd").saveAsTable(name)
    shards = spark.table(name)
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))

    sent = shards.mapInArrow(lambda it: send_hashes(it, bits), "bucket int, shard long, values binary, counts binary")
    anchors = by_bucket_rows(sent, bits).mapInArrow(answer_hashes, ANSWER_SCHEMA)
    anchors = cut(anchors)
    keyed, replies = shards.groupBy("shard"), anchors.groupBy("shard")
    fragments = keyed.cogroup(replies).applyInArrow(lambda s, a: send_fragments(s, a, bits), FRAGMENT_SCHEMA)
    found = cut(by_bucket_rows(fragments, bits).mapInArrow(answer_fragments, ANSWER_SCHEMA))
    return keyed.cogroup(anchors.unionByName(found).groupBy("shard")).applyInArrow(lambda s, a: cut_shards(s, a, bits), CUT_SCHEMA)


def by_bucket_rows(rows: DataFrame, bits: int) -> DataFrame:
    return rows.repartition(min(MOST_TASKS, 1 << bits), "bucket").sortWithinPartitions("bucket")


def dedup_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), kept in the checkpoint folder."""
    found = repeated_spans(df, id_col, text_col)
    try:
        return cut(found.rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    finally:
        found.drop()


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The same by a table of all strings, for tests."""
    least: dict[bytes, int] = {}
    coded = [(i, NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for _, order, raw in coded:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(order, least.get(s, order))
    out = []
    for i, order, raw in coded:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < order:
                gone[p : p + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
