"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two adjacent blocks of words, half overlapping.  Their
TF-IDF vectors over the benchmark's terms give a latent space: the right singular
vectors of the matrix of all passages, by a randomised SVD whose one product with the
corpus is summed up by the tasks (a Nystroem step turns it into singular vectors).
The items' own vectors are added to that matrix with weight, and the rank exceeds
the number of items, so no item lies outside the space.  Passages whose latent vector
has a high cosine to an item's are candidates.  So is, whatever its cosine, all text
that has enough of an item's words to be a leak (``Cover``), so none is lost to words
that are frequent because the item itself is.  For each, the longest common
subsequence of words with the text around the passage is measured.  The words in
common must not be just the frequent ones, that is they must also make up enough of the
item's inverse document frequencies: less if they are nearly the whole item, or half of
it with the answer (the item's answer column, else its last words) in one piece, and
more if they are a looser paraphrase.

Three scans of the texts, no shuffle of them: document frequencies, the product, the
search.  What tasks send on is of fixed size (frequencies) or as large as the
benchmark's vocabulary.  The benchmark is the stated query set; its items make models
in blocks of ``BLOCK_ITEMS``, and ``AT_A_TIME`` blocks go through one product and one
search of texts that are split into words once.

Defined results: null and empty texts are clean; an item of fewer than ``MIN_WORDS``
words is a leak where it stands in one piece; null items and items without words are
passed over; repeated items are reported under each id.  Item ids that are no integers
are reported as text.  An empty benchmark leaves every document clean; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sums import PART_SCHEMA, ROWS, packed_rows, summed, summed_parts, task_number

#: Words in a block; a passage is two adjacent blocks.
BLOCK_WORDS = 32
#: Hashed terms whose document frequencies are counted, and buckets of the term table.
DF_BITS, LUT_BITS = 18, 22
#: Terms in more than this share of documents, and more than so many, describe no item that has enough rarer ones.
MAX_DF, FEW, MIN_TERMS = 0.01, 5, 8
#: Latent dimensions besides one for each item, weight of the items' rows, seed.
EXTRA_RANK, ITEM_WEIGHT, SEED = 56, 4.0, 5
BLOCK_ITEMS, AT_A_TIME = 256, 4
#: Bits of a part's number inside its block's product.
PART_BITS = 20
#: Cells of a table of stretches and words.
CELLS = 1 << 22
#: Cosine of a candidate; shares of an item in common that make a leak: by number and by weight, by both alike, by number with the answer.
COSINE, LEAK, LIGHT, LOOSE, PARAPHRASE = 0.2, 0.7, 0.35, 0.55, 0.5
MIN_WORDS, ANSWER_WORDS = 5, 5

#: ASCII punctuation, read as white space.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BLANKS).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def all_hashes(texts: list[list[bytes]]) -> np.ndarray:
    return np.concatenate([hashes_of(w) for w in texts]) if len(texts) else np.zeros(0, np.uint32)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents and, by hashed term, the number that have it, as packed parts."""
    df, n = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            df[np.unique(hashes_of(words_of(text)) & np.uint32((1 << DF_BITS) - 1))] += 1
    if n:
        yield packed_rows(np.append(df, n)[:, None], ROWS * 64, task_number())


@dataclass
class Terms:
    """The terms that describe the items of a block: hashed words to columns, and their weights.

    Words whose hashes meet in the table of ``LUT_BITS`` are one term.
    """

    columns: dict[int, int]
    idf: np.ndarray
    df_idf: np.ndarray  # for any word by its hash, for the length of a passage
    lut: np.ndarray | None = field(default=None, repr=False)

    def table(self) -> np.ndarray:
        if self.lut is None:
            self.lut = np.full(1 << LUT_BITS, -1, np.int32)
            self.lut[list(self.columns)] = list(self.columns.values())
        return self.lut

    def __getstate__(self):
        return self.__dict__ | {"lut": None}

    def entries(self, texts: list[list[bytes]], hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, column) of the described words, squared length and document of each block."""
        lens = np.array([len(w) for w in texts], np.int64)
        hashes = all_hashes(texts) if hashes is None else hashes
        n_blocks = np.maximum(1, -(-lens // BLOCK_WORDS))
        first = np.cumsum(n_blocks) - n_blocks
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(lens) - lens, lens)
        block = np.repeat(first, lens) + place // BLOCK_WORDS
        idf = self.df_idf[hashes & np.uint32((1 << DF_BITS) - 1)]
        length = np.bincount(block, idf * idf, int(n_blocks.sum()))
        column = self.table()[hashes & np.uint32((1 << LUT_BITS) - 1)]
        own = np.flatnonzero(column >= 0)
        return block[own], column[own], length, np.repeat(np.arange(len(texts)), n_blocks)


def latent(block: np.ndarray, column: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks with described words, ascending, and for each the sum of ``rows`` over its words."""
    if not len(block):
        return block, np.zeros((0, rows.shape[1]), rows.dtype)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    by_size = np.argsort(-sizes, kind="stable")
    at, sizes = starts[by_size], sizes[by_size]
    sums = rows[column[at]]
    for j in range(1, int(sizes[0])):  # a block has BLOCK_WORDS words at most
        n = int(np.searchsorted(-sizes, -j, "left"))  # blocks with more than j words
        sums[:n] += rows[column[at[:n] + j]]
    out = np.empty_like(sums)
    out[by_size] = sums
    return block[starts], out


def add_by_column(total: np.ndarray, column: np.ndarray, row: np.ndarray, vectors: np.ndarray, step: int = 2048) -> None:
    """Add to each line of ``total`` the vectors of its column's entries; sums are products with 0-1 matrices."""
    order = np.argsort(column, kind="stable")
    for at in range(0, len(order), step):
        some = order[at : at + step]
        used, place = np.unique(column[some], return_inverse=True)
        ones = np.zeros((len(used), len(some)), np.float32)
        ones[place, np.arange(len(some))] = 1
        total[used] += ones @ vectors[row[some]]


def place_of(wanted: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in ``ascending``, -1 if it does not."""
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return np.where(ascending[at] == wanted, at, -1)


def passages(blocks: np.ndarray, vectors: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, vector, length) of the passages that have described words: each block with the next of its document."""
    last = len(doc) - 1
    before = blocks[blocks > 0] - 1
    firsts = np.union1d(blocks, before[doc[before] == doc[before + 1]])
    paired = (firsts < last) & (doc[np.minimum(firsts + 1, last)] == doc[firsts])
    padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    a, b = place_of(firsts, blocks), np.where(paired, place_of(firsts + 1, blocks), -1)
    size = length[firsts] + np.where(paired, length[np.minimum(firsts + 1, last)], 0)
    return firsts, padded[a] + padded[b], np.sqrt(size)


def rank_of(terms: Terms, n_items: int) -> int:
    return min(len(terms.idf), n_items + EXTRA_RANK)


def gaussian(terms: Terms, rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((len(terms.idf), rank))


class Product:
    """A task's share of ``A' A G`` for its passages ``A`` and a Gaussian ``G``."""

    def __init__(self, terms: Terms, rank: int):
        self.terms, self.rank = terms, rank
        self.weighted = gaussian(terms, rank).astype(np.float32) * terms.idf[:, None].astype(np.float32)
        self.total = np.zeros((len(terms.idf), rank), np.float64)
        self.seen = False

    def add(self, texts: list[list[bytes]], hashes: np.ndarray) -> None:
        block, column, length, doc = self.terms.entries(texts, hashes)
        if not len(block):
            return
        self.seen = True
        blocks, y = latent(block, column, self.weighted)
        firsts, vectors, size = passages(blocks, y, length, doc)
        # Passages count by their direction, so long and loud ones do not drown the rest.
        vectors /= np.maximum(size * size, 1e-9)[:, None].astype(np.float32)
        joined = np.concatenate([vectors, np.zeros((1, self.rank), np.float32)])
        ahead = np.where((blocks > 0) & (doc[np.maximum(blocks - 1, 0)] == doc[blocks]), place_of(blocks - 1, firsts), -1)
        back = joined[place_of(blocks, firsts)] + joined[ahead]
        add_by_column(self.total, column, np.searchsorted(blocks, block), back)


def products(batches: Iterator[pa.RecordBatch], models: list[tuple[Terms, int]]) -> Iterator[pa.RecordBatch]:
    """The products of several blocks of items, from texts that are split once; each has its own numbers of parts."""
    made = [Product(terms, rank) for terms, rank in models]
    for batch in batches:
        for texts in portions(batch):
            hashes = all_hashes(texts)
            for one in made:
                one.add(texts, hashes)
    for at, one in enumerate(made):
        if one.seen:
            yield packed_rows(one.total * one.terms.idf[:, None], giver=task_number(), first=at << PART_BITS)


def portions(batch: pa.RecordBatch, words: int = 200_000) -> Iterator[list[list[bytes]]]:
    """The texts of a batch as words, some at a time."""
    some, n = [], 0
    for text in batch.column(0).to_pylist():
        some.append(w := words_of(text))
        n += len(w)
        if n >= words:
            yield some
            some, n = [], 0
    if some:
        yield some


def singular_vectors(z: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from ``z = A' A gauss``, largest first (a Nystroem step with a small shift)."""
    if not z.any():
        return np.zeros((len(z), 0))
    shift = 1e-10 * np.linalg.norm(z)
    y = z + shift * gauss
    inner = gauss.T @ y
    inner = (inner + inner.T) / 2
    values, vectors = np.linalg.eigh(inner)
    keep = values > max(values.max(), 0.0) * 1e-12
    if not keep.any():
        return np.zeros((len(z), 0))
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, s > s[0] * 1e-7] if len(s) and s[0] > 0 else u[:, :0]


@dataclass
class Item:
    """An item of the benchmark; ``weights`` are the inverse document frequencies of its words."""

    item_id: int | str
    words: list[bytes]
    answer: list[bytes]
    weights: np.ndarray | None = None
    held_places: dict[bytes, int] | None = field(default=None, repr=False)

    def places(self) -> dict[bytes, int]:
        if self.held_places is None:
            self.held_places = places_of(self.words)
        return self.held_places


class Cover:
    """Finds all text that has enough of an item's words to be a leak, in whatever order.

    Texts are cut into half overlapping stretches, so long that one holds the whole text
    around any passage.  A common subsequence has no more words than the item's words
    that occur in the stretch; words that share a bucket only add to that.
    """

    def __init__(self, items: list[Item]):
        self.items = items
        self.step = -(-(2 * BLOCK_WORDS + 2 * max(len(x.words) for x in items)) // BLOCK_WORDS)  # blocks
        mask = np.uint32((1 << LUT_BITS) - 1)
        own = [hashes_of(x.words) & mask for x in items]
        answers = [hashes_of(x.answer) & mask for x in items]
        buckets = np.unique(np.concatenate([*own, *answers]))
        self.lut = np.full(1 << LUT_BITS, -1, np.int32)
        self.lut[buckets] = np.arange(len(buckets))
        self.counts = np.zeros((len(buckets), len(items)), np.float32)
        for i, h in enumerate(own):
            np.add.at(self.counts[:, i], self.lut[h], 1)
        weights = [x.weights if x.weights is not None else np.ones(len(x.words)) for x in items]
        self.weights = np.zeros_like(self.counts)
        for i, (h, w) in enumerate(zip(own, weights, strict=True)):
            np.add.at(self.weights[:, i], self.lut[h], w)
        # The columns of an item's answer, the first one again where others have more; those without an answer never have it all.
        longest = max(1, *map(len, answers))
        self.answers = np.array([np.resize(self.lut[h], longest) if len(h) else np.zeros(longest, np.int32) for h in answers])
        self.answered = np.array([len(h) > 0 for h in answers])
        sizes = np.array([len(x.words) for x in items])
        # Half a word less, so that no rounding excludes a share that ``shared`` accepts.
        self.leak, self.loose, self.paraphrase = ((sizes * share - 0.5).astype(np.float32) for share in (LEAK, LOOSE, PARAPHRASE))
        self.light, self.heavy = (np.array([w.sum() * share * 0.999 for w in weights], np.float32) for share in (LIGHT, LOOSE))

    def stretches(self, texts: list[list[bytes]], hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, first block, last and one more, item) of the stretches that may have a leak."""
        lens = np.array([len(w) for w in texts], np.int64)
        n_blocks = np.maximum(1, -(-lens // BLOCK_WORDS))
        n_stretches = np.maximum(1, -(-n_blocks // self.step) - 1)
        first = np.cumsum(n_stretches) - n_stretches
        total = int(n_stretches.sum())
        column = self.lut[hashes & np.uint32((1 << LUT_BITS) - 1)]
        use = np.flatnonzero(column >= 0)
        doc = np.repeat(np.arange(len(texts)), lens)[use]
        half = (use - (np.cumsum(lens) - lens)[doc]) // (BLOCK_WORDS * self.step)
        column = column[use]
        stretch = first[doc] + half
        # A word is in the stretch that begins with its half and in the one before.
        begins, goes_on = half < n_stretches[doc], half > 0
        row = np.concatenate([stretch[begins], stretch[goes_on] - 1])
        column = np.concatenate([column[begins], column[goes_on]])
        order = np.argsort(row, kind="stable")
        row, column = row[order], column[order]
        size = max(1, CELLS // len(self.counts))
        for at in range(0, total, size):
            a, b = np.searchsorted(row, (at, at + size))
            has = np.zeros((min(size, total - at), len(self.counts)), np.float32)
            has[row[a:b] - at, column[a:b]] = 1
            shared = has @ self.counts
            rows, found = np.nonzero(shared >= self.paraphrase)
            weigh = np.unique(rows[shared[rows, found] >= self.loose[found]])
            weight = np.zeros((len(has), 0), np.float32)
            if len(weigh):
                weight = np.zeros(shared.shape, np.float32)
                weight[weigh] = has[weigh] @ self.weights
            if not len(rows):
                continue
            held, known = shared[rows, found], self.answered[found]
            enough = np.zeros(len(rows), bool)
            if len(weigh):
                least = np.where(held >= self.leak[found], self.light[found], self.heavy[found])
                enough = (held >= self.loose[found]) & (weight[rows, found] >= least)
            rest = np.flatnonzero(~enough & known)
            rest = rest[(has[rows[rest, None], self.answers[found[rest]]] > 0).all(axis=1)]
            # With the answer a leak needs the least weight, but no less.
            for some in np.array_split(rest, -(-len(rest) * len(self.counts) // CELLS)) if len(rest) else ():
                enough[some] = (has[rows[some]] * self.weights.T[found[some]]).sum(axis=1) >= self.light[found[some]]
            rows, found = rows[enough] + at, found[enough]
            texts_of = np.searchsorted(first, rows, "right") - 1
            begin = (rows - first[texts_of]) * self.step
            end = np.minimum(begin + 2 * self.step, n_blocks[texts_of])
            yield from zip(texts_of.tolist(), begin.tolist(), end.tolist(), found.tolist(), strict=True)


@dataclass
class Search:
    """What a task needs to search its documents for the items of a block."""

    items: list[Item]
    terms: Terms
    latent_terms: np.ndarray  # term x dimension, weighted
    queries: np.ndarray  # item x dimension, of length 1
    cover: Cover | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cover": None}

    def leaks(self, texts: list[list[bytes]], hashes: np.ndarray, found: list[dict[int | str, float]]) -> None:
        """Adds to ``found`` the share of each item that leaked into each text."""
        self.cover = self.cover or Cover(self.items)
        near = set(self.candidates(texts, hashes))
        for doc, begin, end, item in self.cover.stretches(texts, hashes):
            # No passage has more of an item than the whole stretch.
            if self.shared(texts[doc], begin, self.items[item], end):
                near.update((doc, k, item) for k in range(begin, end))
        for doc, first, item in sorted(near):
            share = self.shared(texts[doc], first, self.items[item])
            if share > found[doc].get(self.items[item].item_id, 0.0):
                found[doc][self.items[item].item_id] = share

    def candidates(self, texts: list[list[bytes]], hashes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(text, block of the text, item) of the passages near an item."""
        block, column, length, doc = self.terms.entries(texts, hashes)
        if not len(block):
            return []
        # No cosine exceeds the described share of a passage's length, so weaker passages need no product.
        weight = np.bincount(block, self.terms.idf[column] ** 2, len(length))
        ahead = np.r_[doc[1:] == doc[:-1], False]
        strong = weight + np.where(ahead, np.r_[weight[1:], 0], 0) >= (COSINE**2 / 2) * (length + np.where(ahead, np.r_[length[1:], 0], 0))
        use = (strong | np.r_[False, strong[:-1]])[block]
        blocks, y = latent(block[use], column[use], self.latent_terms)
        if not len(blocks):
            return []
        firsts, vectors, size = passages(blocks, y, length, doc)
        hit, item = np.nonzero(vectors @ self.queries.T >= COSINE * size[:, None].astype(np.float32))
        start = np.searchsorted(doc, np.arange(len(texts)))
        d = doc[firsts[hit]]
        return list(zip(d.tolist(), (firsts[hit] - start[d]).tolist(), item.tolist(), strict=True))

    def shared(self, words: list[bytes], first: int, item: Item, end: int | None = None) -> float:
        """The share of the item that the text around the passages of blocks ``first`` up to ``end`` has in order, 0 if that is no leak."""
        n = len(item.words)
        region = words[max(0, first * BLOCK_WORDS - n) : ((first + 1 if end is None else end) + 1) * BLOCK_WORDS + n]
        if n < MIN_WORDS:
            return 1.0 if contains(region, item.words) else 0.0
        places = item.places()
        own = [w for w in region if w in places]
        if len(own) < PARAPHRASE * n:
            return 0.0
        share = common_length(item.words, own, places) / n
        if share < PARAPHRASE:
            return 0.0
        told = share >= LEAK or contains(region, item.answer)
        return share if (told or share >= LOOSE) and common_weight(item, own) >= (LIGHT if told else LOOSE) else 0.0


def places_of(words: list[bytes]) -> dict[bytes, int]:
    """For each word a bit for each of its places."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    return places


def common_length(a: list[bytes], b: list[bytes], places: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time."""
    places = places_of(a) if places is None else places
    free = whole = (1 << len(a)) - 1
    for w in b:
        hit = free & places.get(w, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & whole
    return len(a) - free.bit_count()


def common_weight(item: Item, region: list[bytes]) -> float:
    """The heaviest common subsequence's share of the item's weight."""
    weights = np.ones(len(item.words)) if item.weights is None else item.weights
    best = np.zeros(len(region) + 1)
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(region):
        at.setdefault(w, []).append(i)
    for word, weight in zip(item.words, weights.tolist(), strict=True):
        if word in at:
            places = np.array(at[word])
            new = best.copy()
            new[places + 1] = np.maximum(new[places + 1], best[places] + weight)
            best = np.maximum.accumulate(new)
    return float(best[-1] / max(weights.sum(), 1e-12))


def contains(region: list[bytes], part: list[bytes]) -> bool:
    n, at = len(part), -1
    for _ in range(region.count(part[0]) if n else 0):
        at = region.index(part[0], at + 1)
        if region[at : at + n] == part:
            return True
    return False


def read_items(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> list[Item]:
    """The query set, which is the driver's by statement; block by block it goes to the tasks."""
    answer = F.col(f"`{answer_col}`") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(f"`{item_col}`").cast(id_type(benchmark, item_col)).alias("i"), F.col(f"`{text_col}`").alias("t"), answer.alias("a")).filter("i IS NOT NULL AND t IS NOT NULL")
    items = []
    for r in rows.toLocalIterator():
        if w := words_of(r["t"]):
            items.append(Item(r["i"], w, words_of(r["a"]) if r["a"] else w[-ANSWER_WORDS:]))
    return sorted(items, key=lambda x: (x.item_id, x.words))


def id_type(benchmark: DataFrame, item_col: str) -> str:
    return "long" if isinstance(benchmark.schema[item_col].dataType, T.IntegralType) else "string"


def describe(items: list[Item], df: np.ndarray, n_docs: float) -> Terms:
    """Each item's terms: those rare enough, or its rarest ones if they are few."""
    idf_of = lambda count: math.log((1 + n_docs) / (1 + count)) + 0.1
    columns: dict[int, int] = {}
    counts: list[float] = []
    for item in items:
        own = sorted({zlib.crc32(w) for w in item.words}, key=lambda h: (df[h & ((1 << DF_BITS) - 1)], h))
        for i, h in enumerate(own):
            count = df[h & ((1 << DF_BITS) - 1)]
            at = h & ((1 << LUT_BITS) - 1)
            if (i < MIN_TERMS or count <= max(FEW, MAX_DF * n_docs)) and at not in columns:
                columns[at] = len(columns)
                counts.append(count)
    return Terms(columns, np.array([idf_of(c) for c in counts]), (np.log((1 + n_docs) / (1 + df)) + 0.1).astype(np.float32))


def item_rows(items: list[Item], terms: Terms) -> np.ndarray:
    out = np.zeros((len(items), len(terms.idf)))
    for i, item in enumerate(items):
        for w in item.words:
            c = terms.columns.get(zlib.crc32(w) & ((1 << LUT_BITS) - 1))
            if c is not None:
                out[i, c] = terms.idf[c]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(row, leaks): each row of ``docs`` as a struct, and the items leaked into it with the share found."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"`{text_col}`").alias("text")
    kind = id_type(benchmark, item_col)
    leak_type = f"array<struct<item_id:{kind},share:double>>"
    items = read_items(benchmark, item_col, bench_text_col, answer_col)
    out = docs.select(row, text, F.array().cast(leak_type).alias("leaks"))
    if items:
        counted = summed(docs.select(text).mapInArrow(count_terms, PART_SCHEMA), 1)
        if counted is not None:
            df, n_docs = counted[:-1, 0], counted[-1, 0]
            blocks = [items[at : at + BLOCK_ITEMS] for at in range(0, len(items), BLOCK_ITEMS)]
            for at in range(0, len(blocks), AT_A_TIME):
                searches = prepare(docs.select(text), blocks[at : at + AT_A_TIME], df, n_docs)
                out = out.select("row", "text", F.concat("leaks", search_udf(searches, kind)("text")).alias("leaks"))
    return out.select("row", "leaks")


def prepare(texts: DataFrame, blocks: list[list[Item]], df: np.ndarray, n_docs: float) -> list[Search]:
    """The latent space of each block of items, from one scan."""
    models = []
    for items in blocks:
        terms = describe(items, df, n_docs)
        for x in items:
            x.weights = terms.df_idf[hashes_of(x.words) & np.uint32((1 << DF_BITS) - 1)].astype(float)
        models.append((terms, rank_of(terms, len(items))))
    sums = summed_parts(texts.mapInArrow(lambda it: products(it, models), PART_SCHEMA))
    out = []
    for at, (items, (terms, rank)) in enumerate(zip(blocks, models, strict=True)):
        own = item_rows(items, terms)
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        gauss = gaussian(terms, rank)
        mine = [sums[p].reshape(-1, rank) for p in sorted(sums) if p >> PART_BITS == at]
        z = np.concatenate(mine) if mine else np.zeros((len(terms.idf), rank))
        scale = max(1.0, np.linalg.norm(z, axis=0).mean() / math.sqrt(rank))
        z = z + ITEM_WEIGHT * scale * (own.T @ (own @ gauss))
        vectors = singular_vectors(z, gauss)
        queries = own @ vectors
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        out.append(Search(items, terms, (vectors * terms.idf[:, None]).astype(np.float32), queries.astype(np.float32)))
    return out


def search_texts(batch: pa.RecordBatch, searches: list[Search]) -> list[list[dict]]:
    """The items leaked into each text of a batch, with their shares."""
    out: list[list[dict]] = []
    for texts in portions(batch):
        found: list[dict[int | str, float]] = [{} for _ in texts]
        hashes = all_hashes(texts)
        for search in searches:
            search.leaks(texts, hashes, found)
        out += [[{"item_id": i, "share": s} for i, s in sorted(f.items())] for f in found]
    return out


def search_udf(searches: list[Search], kind: str):
    @F.arrow_udf(f"array<struct<item_id:{kind},share:double>>")
    def leaks(texts: pa.Array) -> pa.Array:
        out = search_texts(pa.record_batch([texts], names=["text"]), searches)
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64() if kind == "long" else pa.string()), ("share", pa.float64())])))

    return leaks
