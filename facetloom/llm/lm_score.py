"""Language-model scores by masked pseudo-likelihood.

A small network predicts each word of a text from the words on both sides: the
vectors of the ``SIDE`` words before and after go through one hidden layer, which
predicts the word in three steps, its group, its place in the group and, for words
that share a place, its share of the corpus's count of that place.  A document's score
is the sum of the log-probabilities of its words, each given the others around it.

All words of all documents are counted.  The most frequent ones have places of their
own, all others share places by hash, and each has its own counted share there, so the
vocabulary grows with the corpus and the probabilities of all counted words add up to
one.  Texts are read once more and become names, two bytes a word, which training and
scoring use.  Every word of every document is a training example: documents are dealt
to learners by a hash of id and text, whatever the table's files, the learners grow in
number with the corpus, and each runs through its own documents as a stream.  After
every ``SYNCS``-th of its documents the learners' weights are averaged by tasks; one
set of weights returns to the driver.

Defined results: null and empty texts have no words, log-probability 0 and mean 0;
equal texts score alike; words are in lower case; a word that was never counted has
the share of one occurrence more.  An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder
from .sums import PART_SCHEMA, packed_rows, summed

#: Words are named in groups; the last groups are for words outside the vocabulary, by hash.
GROUPS, PLACES, RARE_GROUPS = 64, 64, 16
#: Words on each side, sizes of word vectors and of the hidden layer.
SIDE, VECTOR, HIDDEN = 2, 12, 32
#: Averages of the learners in one run through the corpus, runs, examples in a step, rate and seed.
SYNCS, ROUNDS, STEP, RATE, SEED = 4, 1, 256, 0.2, 3
#: Words for each learner, and the most learners there are.
LEARNER_WORDS, MOST_LEARNERS = 1 << 20, 8192
#: Places scored at once, those of them whose numbers stay in the processor's cache, and weights in one part of a sum.
AT_ONCE, BLOCK, PART = 1 << 14, 1 << 10, 1 << 11
#: Bytes of text that are split into words at once.
PIECE = 1 << 23
#: Words that tasks hold with their shares; rarer ones are looked up in a join, which gives the same.
HELD = 1 << 18
#: The largest logit.
MOST_LOGIT = 60
#: Log-shares are added up as whole numbers, so that their order does not matter.
SCALE = 1e9

N_WORDS = GROUPS * PLACES
N_KNOWN = (GROUPS - RARE_GROUPS) * PLACES
EDGE = N_WORDS  # the name of what lies beyond a text's ends


class Vocabulary(dict):
    """Places in a list of words, most frequent first; a word that is not in it has minus one less its shared place.

    Words from place ``N_KNOWN`` on share places too, but their log-shares, as whole
    numbers, are at hand: only rarer words need be looked up in the full counts.
    """

    def __init__(self, words: list[bytes] = (), shares: np.ndarray | None = None):
        super().__init__((w, i) for i, w in enumerate(words))
        self.shares = np.zeros(len(words), np.int64) if shares is None else shares
        own = np.arange(len(words))
        self.names = np.where(own < N_KNOWN, own, [N_KNOWN + shared_place(w) for w in words])

    def __missing__(self, word: bytes) -> int:
        return -1 - shared_place(word)

    def __reduce__(self):
        return Vocabulary, (list(self), self.shares)

    def names_of(self, places: np.ndarray) -> np.ndarray:
        """The names, as the network knows them, of words by place."""
        if not len(self.names):
            return N_KNOWN - 1 - places
        return np.where(places < 0, N_KNOWN - 1 - places, self.names[np.maximum(places, 0)])


def shared_place(word: bytes) -> int:
    return zlib.crc32(word) % (N_WORDS - N_KNOWN)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def places_of(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def names_of(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    return vocabulary.names_of(places_of(words, vocabulary))


def padded(names: np.ndarray) -> np.ndarray:
    edge = np.full(SIDE, EDGE, names.dtype)
    return np.concatenate([edge, names, edge])


def contexts(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The names around places of a padded text, those before first."""
    offsets = [o for o in range(2 * SIDE + 1) if o != SIDE]
    return row[at[:, None] + np.array(offsets)]


@dataclass
class Network:
    """Weights: word vectors, hidden layer, group and place predictions, and what the group adds to the hidden state."""

    vectors: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    given: np.ndarray
    place: np.ndarray
    place_bias: np.ndarray

    @staticmethod
    def start(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        some = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        none = lambda n: np.zeros(n, np.float32)
        vectors = (rng.standard_normal((N_WORDS + 1, VECTOR)) * 0.3).astype(np.float32)
        return Network(vectors, some(2 * SIDE * VECTOR, HIDDEN), none(HIDDEN), some(HIDDEN, GROUPS) * 0.1, none(GROUPS), np.zeros((GROUPS, HIDDEN), np.float32), some(HIDDEN, PLACES) * 0.1, none(PLACES))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.hidden, self.hidden_bias, self.group, self.group_bias, self.given, self.place, self.place_bias]

    def packed(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts())

    @staticmethod
    def unpacked(data: bytes) -> Network:
        out, at, raw = Network.start(), 0, np.frombuffer(data, "<f4")
        parts = []
        for p in out.parts():
            parts.append(raw[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*parts)

    def log_probabilities(self, around: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Of each word given the words around it."""
        out = np.empty(len(names), self.vectors.dtype)
        for at in range(0, len(names), BLOCK):
            out[at : at + BLOCK] = self.block_log_probabilities(around[at : at + BLOCK], names[at : at + BLOCK])
        return out

    def inputs(self, around: np.ndarray) -> np.ndarray:
        return self.vectors.take(around.astype(np.intp, copy=False).ravel(), axis=0).reshape(len(around), -1)

    def layers(self, x: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden states for the group and for the place, their logits, and where those of the words themselves are.

        Both kinds lie in one array, so that what is done to either is one operation.
        """
        n = len(x)
        h = np.empty((2, n, HIDDEN), x.dtype)
        before = np.matmul(x, self.hidden, out=h[0])
        before += self.hidden_bias
        np.add(before, self.given.take(group, axis=0), out=h[1])
        np.tanh(h, out=h)
        z = np.empty((2, n, PLACES), x.dtype)
        for own, state, weights, bias in zip(z, h, (self.group, self.place), (self.group_bias, self.place_bias), strict=True):
            logits(state, weights, bias, own)
        at = np.arange(0, z.size, PLACES)
        at[:n] += group
        at[n:] += place
        return h, z, at

    def block_log_probabilities(self, around: np.ndarray, names: np.ndarray) -> np.ndarray:
        group, place = group_and_place(names)
        _, z, at = self.layers(self.inputs(around), group, place)
        own = z.reshape(-1).take(at)
        np.exp(z, out=z)
        own -= np.log(row_sums(z.reshape(-1, PLACES)))
        return own[: len(names)] + own[len(names) :]

    def descents(self, around: np.ndarray, names: np.ndarray, weight: float = 1.0, out: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the negative log-likelihood's sum, times ``weight``, for all but the vectors, and for the vectors of each example."""
        n = len(names)
        x = self.inputs(around)
        group, place = group_and_place(names)
        h, d, at = self.layers(x, group, place)
        np.exp(d, out=d)
        lines = d.reshape(-1, PLACES)
        lines *= (weight / row_sums(lines))[:, None]
        d.reshape(-1)[at] -= weight
        b = np.empty_like(h)
        np.matmul(d[0], self.group.T, out=b[0])
        np.matmul(d[1], self.place.T, out=b[1])
        b *= 1 - h * h
        of_group = np.zeros((n, GROUPS), x.dtype)
        of_group.reshape(-1)[at[:n]] = 1
        out = [np.empty_like(p) for p in self.parts()[1:]] if out is None else out
        hidden, hidden_bias, to_group, group_bias, given, to_place, place_bias = out
        np.matmul(of_group.T, b[1], out=given)
        both = b[0]
        both += b[1]
        each = np.ones(n, x.dtype)
        for weights, bias, left, right in ((hidden, hidden_bias, x, both), (to_group, group_bias, h[0], d[0]), (to_place, place_bias, h[1], d[1])):
            np.matmul(left.T, right, out=weights)
            np.matmul(each, right, out=bias)
        return out, (both @ self.hidden.T).reshape(n, 2 * SIDE, VECTOR)

    def learn(self, examples: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
        """One run through a stream of examples, with steps scaled by the size of past ones."""
        parts = self.parts()[1:]
        # All weights but the vectors are pieces of one array, so that a step is a few operations on the whole of it.
        whole = np.concatenate([p.ravel() for p in parts])
        g = np.empty_like(whole)
        pieces, of_pieces = ([w.reshape(p.shape) for w, p in zip(np.split(a, np.cumsum([p.size for p in parts])[:-1]), parts, strict=True)] for a in (whole, g))
        self.hidden, self.hidden_bias, self.group, self.group_bias, self.given, self.place, self.place_bias = pieces
        past, some = np.full(len(whole), 1e-4, np.float32), np.empty_like(whole)
        past_vectors = np.full(len(self.vectors), 1e-4, np.float32)
        # Numbers of the vectors' gradients are added up in pairs, as complex ones, which halves the additions.
        pairs = VECTOR // 2
        turn, columns, seen_now = np.zeros(len(self.vectors), np.intp), np.zeros(0, np.intp), np.zeros(len(self.vectors), bool)
        seen = 0
        for around, names in examples:
            n = len(names)
            seen += n
            around = around.astype(np.intp)
            _, of_vectors = self.descents(around, names, 1 / n, of_pieces)
            np.multiply(g, g, out=some)
            past += some
            np.sqrt(past, out=some)
            g /= some
            g *= rate
            whole -= g
            flat = around.ravel()
            seen_now[flat] = True
            used = np.flatnonzero(seen_now)
            seen_now[used] = False
            turn[used] = np.arange(0, len(used) * pairs, pairs)
            cells = np.repeat(turn.take(flat), pairs)
            if len(cells) > len(columns):
                columns = np.tile(np.arange(pairs), len(flat))
            cells += columns[: len(cells)]
            sums = np.zeros(len(used) * pairs, np.complex64)
            np.add.at(sums, cells, of_vectors.reshape(-1).view(np.complex64))
            of_used = sums.view(np.float32).reshape(-1, VECTOR)
            sizes = past_vectors.take(used)
            sizes += row_sums(of_used * of_used) / VECTOR
            past_vectors[used] = sizes
            of_used *= (rate / np.sqrt(sizes))[:, None]
            self.vectors[used] = self.vectors.take(used, axis=0) - of_used
        return seen


def group_and_place(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = names.astype(np.intp, copy=False)
    group = names // PLACES
    return group, names - group * PLACES


def row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[1], a.dtype)


def logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Bounded, so that their exponentials are finite."""
    z = np.matmul(h, weights, out=out)
    z += bias
    # Hidden states are within 1 of zero, so the weights tell whether any logit can be beyond the bound.
    if not (np.abs(weights).sum(0) + bias).max() < MOST_LOGIT:
        np.minimum(z, z.dtype.type(MOST_LOGIT), out=z)
    return z


@dataclass
class Model:
    """What a corpus teaches: names, weights, the words and their counts (word, h, bucket, n), and the counts of shared places."""

    vocabulary: Vocabulary
    network: Network
    counted: DataFrame
    buckets: list[int]


def lowered(docs: DataFrame, text_col: str):
    return F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, h, bucket, n): all words of all documents, the hash they are looked up by, and their count."""
    texts = docs.select(lowered(docs, text_col).alias("text"))
    words = texts.mapInArrow(count_texts, "word string, n long")
    raw = F.encode("word", "UTF-8")
    bucket = (F.crc32(raw) % (N_WORDS - N_KNOWN)).cast("int")
    return cut(words.groupBy("word").agg(F.sum("n").alias("n")).select("word", F.xxhash64("word").alias("h"), bucket.alias("bucket"), "n"))


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of some texts at a time, counted."""
    for batch in batches:
        for some in in_pieces(batch):
            counted = words_in(some.column("text"))[0].value_counts()
            yield pa.record_batch([counted.field(0).cast(pa.string()), counted.field(1)], names=["word", "n"])


def build_vocabulary(counted: DataFrame) -> tuple[Vocabulary, list[int]]:
    """The most frequent words, and the counts of the places that all but the first of them share."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = dict(counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())  # some hundred rows
    least, total = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        if total >= N_KNOWN and total + sizes[at] > HELD:
            break
        least, total = at, total + sizes[at]
    held = counted.filter(step >= least).orderBy(F.desc("n"), "word").limit(HELD).collect()
    buckets = [0] * (N_WORDS - N_KNOWN)
    if len(held) > N_KNOWN:
        last = held[N_KNOWN - 1]
        rest = counted.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
        for r in rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each shared place
            buckets[r["bucket"]] = r["n"]
    own = [round(math.log(r["n"] / buckets[r["bucket"]]) * SCALE) if i >= N_KNOWN else 0 for i, r in enumerate(held)]
    return Vocabulary([r["word"].encode("utf-8", "replace") for r in held], np.array(own, np.int64)), buckets


def name_texts(batches: Iterator[pa.RecordBatch], words: pa.Array, own_names: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, id, n_words, names, share, rare): texts as names, the log-shares at hand, and the hashes of the words to look up.

    Takes the words of a vocabulary, their names and shares.  Arrow splits some texts at a time and looks the words up.
    """
    for batch in batches:
        for some in in_pieces(batch):
            found, ends = words_in(some.column("text"))
            places = pc.fill_null(pc.index_in(found, value_set=words), -1).to_numpy()
            unheld = np.flatnonzero(places < 0)
            rare = bytes_of(found.take(pa.array(unheld)))
            # Place minus one is that of words not held; it stands for any other until they get what is theirs.
            names = np.append(own_names, 0).astype(np.uint16)[places]
            names[unheld] = [N_KNOWN + shared_place(w) for w in rare]
            share = running(np.append(shares, 0)[places])[ends]
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in rare], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(unheld, ends), pa.int32()), pa.array(hashes))
            data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(names)])
            columns = [some.column(0), some.column(1), pa.array(np.diff(ends)), data, pa.array(np.diff(share)), lists]
            yield pa.record_batch(columns, names=["key", "id", "n_words", "names", "share", "rare"])


def bytes_of(values: pa.Array) -> list[bytes]:
    """The values of a new binary array, some times as fast as its own ``to_pylist``."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32, len(values) + 1).tolist() if len(values) else []
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in itertools.pairwise(ends)]


def running(counts: np.ndarray) -> np.ndarray:
    """Sums of all before each place, and of all."""
    return np.append(0, np.cumsum(counts, dtype=np.int64))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, and where each text's begin and the last one's end."""
    split = pc.ascii_split_whitespace(texts)
    found = split.flatten().cast(pa.binary())
    there = pc.not_equal(pc.binary_length(found), 0)  # white space at a text's end leaves an empty word
    ends = running(there.to_numpy(zero_copy_only=False))[running(pc.list_value_length(split).to_numpy())]
    return found.filter(there), ends


def in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at once as have ``PIECE`` bytes of text; a longer text comes alone."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, own in enumerate(sizes.tolist()):
        if i > at and size + own > PIECE:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += own
    if len(sizes):
        yield batch.slice(at)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as names, stored: training and scoring read them, and a row keeps its key."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").alias("id"), lowered(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    words, names, shares = pa.array(list(vocabulary), pa.binary()), vocabulary.names, vocabulary.shares
    named = rows.mapInArrow(lambda it: name_texts(it, words, names, shares), f"key long, id {kind}, n_words long, names binary, share long, rare array<long>")
    folder = new_folder(docs.sparkSession, "names")
    named.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def steps(texts: Iterator[bytes], size: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Examples a step at a time: every word of every text, with the words around it."""
    held: list[np.ndarray] = []
    n = 0
    for data in texts:
        row = padded(np.frombuffer(data, np.uint16))
        own = len(row) - 2 * SIDE
        for lo in range(0, own, AT_ONCE):
            m = min(AT_ONCE, own - lo)
            examples = np.empty((m, 2 * SIDE + 1), np.uint16)
            for column, offset in enumerate([*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1), SIDE]):
                examples[:, column] = row[lo + offset : lo + offset + m]
            held.append(examples)
            n += m
            if n >= 32 * size:
                yield from whole_steps(held, size)
                n = len(held[0])
    if n:
        some = np.concatenate(held)
        for at in range(0, len(some), size):
            yield some[at : at + size, :-1], some[at : at + size, -1].astype(np.int32)


def whole_steps(held: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The full steps of the examples held; what is left of them stays held."""
    some = np.concatenate(held)
    whole = len(some) - len(some) % size
    for at in range(0, whole, size):
        yield some[at : at + size, :-1], some[at : at + size, -1].astype(np.int32)
    held[:] = [some[whole:]]


def run_learners(batches: Iterator[pa.RecordBatch], weights: bytes, rate: float) -> Iterator[pa.RecordBatch]:
    """The weights of a task's learners times the examples they saw, and last that number, as parts of a sum."""
    parts = ((k, e) for b in batches for k, e in zip(b.column("learner").to_pylist(), b.column("names").to_pylist(), strict=True))
    for learner, own in itertools.groupby(parts, lambda p: p[0]):
        network = Network.unpacked(weights)
        seen = network.learn(steps(e for _, e in own), rate)
        held = np.frombuffer(network.packed(), "<f4").astype(np.float64)
        yield packed_rows(np.append(held * seen, seen)[:, None], PART, learner)


def train_network(texts: DataFrame, learners: int | None = None, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Weights from encoded texts; the number of learners follows the number of words."""
    network = Network.start()
    n_words = texts.agg(F.sum("n_words")).first()[0] or 0
    if not n_words:
        return network
    n = learners or min(MOST_LEARNERS, max(1, math.ceil(n_words / LEARNER_WORDS)))
    mark = F.xxhash64("id", "names")
    turn = F.pmod(F.shiftright(mark, 32), F.lit(SYNCS)).alias("turn")
    some = texts.filter("n_words > 0").select(F.pmod(mark, F.lit(n)).cast("int").alias("learner"), turn, mark.alias("mark"), "names")
    # The order of texts changes the weights, so it is that of their hashes.
    dealt = cut(some.repartition(n, "learner").sortWithinPartitions("learner", "mark").drop("mark"))
    for at in range(rounds * SYNCS):
        weights, step = network.packed(), rate / (1 + at / SYNCS)
        own = dealt.filter(F.col("turn") == at % SYNCS)
        total = summed(own.mapInArrow(lambda it: run_learners(it, weights, step), PART_SCHEMA), 1)  # noqa: B023
        if total is not None:
            network = Network.unpacked((total[:-1, 0] / total[-1, 0]).astype("<f4").tobytes())
    return network


def train(docs: DataFrame, text_col: str = "text", learners: int | None = None, rounds: int = ROUNDS, rate: float = RATE, id_col: str = "doc_id") -> Model:
    """A model of all words of ``docs``."""
    counted = count_words(docs, text_col)
    vocabulary, buckets = build_vocabulary(counted)
    return Model(vocabulary, train_network(encode(docs, vocabulary, id_col, text_col), learners, rounds, rate), counted, buckets)


def score_names(texts: list[bytes], network: Network) -> list[float]:
    """Summed log-probabilities of the names, many short texts or part of a long one at a time."""
    sums = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            found = network.log_probabilities(np.concatenate([c for _, c, _ in held]), np.concatenate([n for _, _, n in held]))
            lens = np.array([len(n) for _, _, n in held])
            owners = np.array([i for i, _, _ in held])
            np.add.at(sums, owners, np.add.reduceat(found.astype(np.float64), np.cumsum(lens) - lens))
        held.clear()
        size = 0

    for i, data in enumerate(texts):
        names = np.frombuffer(data, np.uint16).astype(np.int32)
        row = padded(names)
        for at in range(0, len(names), AT_ONCE):
            places = np.arange(at, min(at + AT_ONCE, len(names)))
            held.append((i, contexts(row, places), names[places]))
            size += len(places)
            if size >= AT_ONCE:
                flush()
    flush()
    return sums.tolist()


def shares(texts: DataFrame, model: Model) -> DataFrame:
    """(key, looked): for each text with words that tasks do not hold, the sum of their log-shares, as whole numbers."""
    words = texts.select("key", F.explode("rare").alias("h"))
    total = F.array(*[F.lit(max(1, n)).cast("double") for n in model.buckets])
    known = model.counted.select("h", (F.log(F.col("n").cast("double")) - F.log(F.element_at(total, F.col("bucket") + 1))).alias("share"))
    unheard = F.lit(-math.log(1 + max(model.buckets)))
    # The counts are the smaller side: a hash table of a partition of them spares the words a sort.
    found = words.join(known.hint("shuffle_hash"), "h", "left").withColumn("share", F.coalesce("share", unheard))
    return found.groupBy("key").agg(F.sum(F.round(F.col("share") * SCALE).cast("long")).alias("looked"))


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """(id, n_words, log_probability, mean_log_probability) for every row of ``texts``, as ``encode`` makes them."""
    weights = model.network.packed()

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = Network.unpacked(weights)
        for names in parts:
            yield pd.Series(score_names(names.tolist(), network), dtype="float64")

    found = texts.select("key", "id", "n_words", "share", score("names").alias("network")).join(shares(texts, model), "key", "left")
    total = F.col("network") + (F.col("share") + F.coalesce(F.col("looked"), F.lit(0))) / F.lit(SCALE)
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(F.lit(0.0))
    return found.select("id", "n_words", total.alias("log_probability"), mean.alias("mean_log_probability"))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` scored by a model of ``docs``."""
    counted = count_words(docs, text_col)
    vocabulary, buckets = build_vocabulary(counted)
    texts = encode(docs, vocabulary, id_col, text_col)
    return scored(texts, Model(vocabulary, train_network(texts), counted, buckets))
