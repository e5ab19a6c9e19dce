"""Language-model scoring by online logistic context mixing.

A text is a sequence of word tokens and one end, coded as a stream of bits along the text:

* Frequent words, the end and the escape to other words are the leaves of a binary tree.  For
  each bit on the way to a leaf three contexts predict: the node alone, the node after the
  previous leaf and the node after the two previous leaves; the latter two are hashed.  A
  mixer adds the predictions in the logistic domain with weights that a gate selects by how
  often the contexts were met.  Along each text, block by block, the weights follow the
  gradient of the code length, and an adaptive map refines the mixed probability.
* After an escape, a word that occurs elsewhere in training is coded by its share of such
  words.  A new one is spelled: for each bit of its bytes the contexts of the last one to
  six bytes and of the whole prefix are mixed in the same way.
* Words are grouped into phrases, which end where a hash of a word says so.  A phrase that
  occurs elsewhere in training may be coded as a whole, by its share of all phrases; how
  likely that is follows what happened at the phrases before.

The sum of code lengths gives total bits per byte.  A training text's own occurrences are
left out of all counts that predict it but those of the tree's nodes, as if it were read for
the first time.  The counts of words and phrases grow with the corpus; the tables of hashed
contexts are broadcast and stay fixed in size.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import SPACES, Tables, crc_mod, hold, prepare, slices

#: Contexts of spelling in bytes back from the coded one; 0 is the whole prefix.  Hash bits of each table.
ORDERS, BITS = (1, 2, 3, 4, 6, 0), (16, 18, 20, 20, 20, 21)
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
SLOTS = int(STARTS[-1])
CHUNK = 1 << 13
#: Bytes with a five-bit code; 31 is the escape before eight plain bits.
COMMON = b" abcdefghijklmnopqrstuvwxyz.,-\xc3"
#: Count classes of the spelling gates, and buckets of the adaptive maps.
CLASSES, BUCKETS = 12, 33
#: Distinct words that train the speller in one task; bytes that it learns and codes at once.
TASK_WORDS, BATCH_BYTES, CODED_BYTES = 500_000, 150_000, 30_000
#: Words in the tree, and words whose counts are broadcast, at most.
TREE_WORDS, KNOWN_WORDS = 1024, 65_536
#: Hash bits of the tables of leaves before; their contexts.
CONTEXT_BITS, CONTEXTS = 21, 2
#: A word in so many ends a phrase; words of the longest phrase; tokens between two updates along a text.
ANCHOR, LONGEST_PHRASE, BLOCK = 64, 256, 64
#: Bytes of texts in a group, tokens that are coded at once, distinct words that a task's tallies hold between two batches.
GROUP_BYTES, BATCH_TOKENS, HELD_WORDS = 32_000_000, 40_000, 500_000
#: First chance of coding a phrase as a whole, and the chance after one.
SELDOM, AGAIN = 0.02, 0.95
#: Step of the weights, pseudo-count of the adaptive map and of hashed contexts.
RATE, PRIOR, SMALL = 0.05, 16.0, 0.4
_C = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD1342543DE82EF95)
END, ESCAPE = 0, 1
#: Bytes of texts with A-Z in lower case and every separator a space.
PLAIN = bytes(32 if chr(b) in SPACES else b for b in bytes(range(256)).lower())


def _code_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the length of its code, the tree nodes passed and the bits taken."""
    length, nodes, bits = np.zeros(256, np.int64), np.zeros((256, 13), np.uint64), np.zeros((256, 13), np.int8)
    for b in range(256):
        code = [(COMMON.index(b) if b in COMMON else 31) >> k & 1 for k in range(4, -1, -1)]
        node = 1
        for k, bit in enumerate(code):
            nodes[b, k], bits[b, k] = node, bit
            node = 2 * node + bit
        if b not in COMMON:
            node = 1
            for k in range(8):
                bit = b >> (7 - k) & 1
                nodes[b, 5 + k], bits[b, 5 + k] = 64 + node, bit
                node = 2 * node + bit
            code += [0] * 8
        length[b] = len(code)
    return length, nodes, bits


LENGTH, NODES, CODE = _code_table()


# -- spelling ------------------------------------------------------------------------
@dataclass
class Events:
    """The coded bits of the distinct prefixes of sorted words, one byte after another.

    ``byte`` numbers the byte of each bit; a byte is new in word ``word`` at position ``pos``.
    """

    byte: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    slot: np.ndarray  # contexts x bits
    word: np.ndarray
    pos: np.ndarray
    shared: np.ndarray  # bytes that each word shares with the one before


def common_prefixes(words: list[bytes], width: int = 48) -> np.ndarray:
    """Length of each sorted word's common prefix with the word before, up to ``width``."""
    n = len(words)
    m = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(n, width)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    size = np.array([len(w) for w in words])
    return np.concatenate([[0], np.minimum(first, np.minimum(size[1:], size[:-1]))]).astype(np.int64)


def events(words: list[bytes]) -> Events:
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    every = np.repeat(np.arange(len(words)), size)
    position = np.arange(len(data)) - start[every]
    shared = common_prefixes(words)
    new = np.flatnonzero(position >= shared[every])
    pos = position[new]
    last = data.astype(np.uint64) + np.uint64(1)
    n = LENGTH[data[new]]
    byte = np.repeat(np.arange(len(new)), n)
    k = np.arange(len(byte)) - np.repeat(np.cumsum(n) - n, n)
    code = data[new][byte]
    node = NODES[code, k]
    salt = node * _P
    slot = np.empty((len(ORDERS), len(byte)), np.int64)
    before = [np.where(pos < j, np.uint64(0), last[np.maximum(new - j, 0)]) for j in range(1, max(ORDERS) + 1)]
    for c, order in enumerate(ORDERS):
        h = np.full(len(new), order + 1, np.uint64)
        if order:
            for x in before[:order]:
                h = (h + x) * _C
                h ^= h >> np.uint64(29)
        else:  # a polynomial over the prefix, by running sums modulo 2 ** 64
            power = np.cumprod(np.full(int(size.max()), _P), dtype=np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last * power[position], dtype=np.uint64)])
            h = (total[new] - total[start[every[new]]]) * _C
            h ^= h >> np.uint64(32)
        h = np.repeat(h, n)
        h += salt
        h *= _C
        h >>= np.uint64(64 - BITS[c])
        np.add(h.view(np.int64), STARTS[c], out=slot[c])
    return Events(byte, CODE[code, k], node.astype(np.int64), slot, every[new], pos, shared)


def prefix_weights(e: Events, counts: np.ndarray) -> np.ndarray:
    """Total weight of the words that pass each new byte: a byte serves the words up to the next shorter common prefix."""
    until = e.word + 1
    order = np.argsort(e.pos, kind="stable")
    begin = 0
    for pos, end in enumerate(np.cumsum(np.bincount(e.pos)[: int(e.shared.max()) + 1]).tolist()):  # beyond all common prefixes a byte serves its word alone
        at = order[begin:end]
        first = np.flatnonzero(e.shared <= pos)
        until[at] = np.append(first, len(counts))[np.searchsorted(first, e.word[at]) + 1]
        begin = end
    total = np.concatenate([[0.0], np.cumsum(counts)])
    return total[until] - total[e.word]


def batches_of(words: list[bytes], counts: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, list[int]]]:
    """Parts of the words in sorted order: words, counts and their numbers."""
    order = sorted(range(len(words)), key=words.__getitem__)
    total = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[order] + 1)
    begin, before = 0, 0
    while begin < len(order):
        end = min(int(np.searchsorted(total, before + most)) + 1, len(order))
        part = order[begin:end]
        yield [words[i] for i in part], counts[part], part
        begin, before = end, int(total[end - 1])


def shrunk(counts: np.ndarray) -> tuple[bytes, tuple[int, ...]]:
    """A table of whole numbers as few bytes, since a broadcast lies on the disk of every executor."""
    return zlib.compress(packed(counts.ravel()), 1), counts.shape


def restored(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"<u{len(raw) // math.prod(shape)}").reshape(shape)


class Speller:
    """Spells words: counts of all slots, gated mixer weights and the adaptive probability map."""

    def __getstate__(self) -> tuple:
        return shrunk(self.counts.T), self.weights, self.seen

    def __setstate__(self, state: tuple) -> None:
        both, self.weights, self.seen = state
        self.counts = restored(*both).T.astype(np.float32, order="C")

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray | None = None, seen: np.ndarray | None = None) -> None:
        self.counts = np.stack([zeros, ones], axis=1).astype(np.float32, copy=False)
        self.weights = np.full((len(ORDERS) + 1, len(ORDERS), CLASSES), 0.35, np.float32) if weights is None else weights
        self.seen = np.zeros((512, BUCKETS, 2)) if seen is None else seen

    def beginner(self) -> Speller:
        """A model that learns from the same counts on its own."""
        out = Speller.__new__(Speller)
        out.counts, out.weights, out.seen = self.counts, self.weights.copy(), self.seen.copy()
        return out

    def inputs(self, e: Events, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions and gate numbers of each context, and the longest context seen."""
        pairs = self.counts.view(np.int64).ravel()  # both counts of a slot are read at once
        a, b = np.empty(e.slot.shape, np.float32), np.empty(e.slot.shape, np.float32)
        for k in range(len(ORDERS)):
            met = pairs.take(e.slot[k]).view(np.float32)
            a[k], b[k] = met[0::2], met[1::2]
        if leave_out:
            one = e.bit.astype(np.float32)
            for x, mine in ((a, 1 - one), (b, one)):
                x -= mine
                np.maximum(x, 0, out=x)
        gate = self.gate(a + b)
        longest = np.zeros(e.slot.shape[1], np.uint8)
        for k in range(len(ORDERS)):
            np.maximum(longest, (gate[k] > 0).view(np.uint8) * np.uint8(k + 1), out=longest)
        a += np.float32(0.02)
        b += np.float32(0.02)
        b /= a
        return np.log(b, out=b), gate, longest

    @staticmethod
    def gate(n: np.ndarray) -> np.ndarray:
        """0 for a context that was never met, else one more than log2 of one more than how often, as the exponent of that number has it."""
        power = (n + np.float32(1)).view(np.int32)
        power >>= 23
        power -= 126
        power *= n > 0
        return np.minimum(power, CLASSES - 1, out=power).astype(np.uint8)

    def mixed(self, e: Events, leave_out: bool = False):
        stretched, gate, longest = self.inputs(e, leave_out)
        s = np.zeros(e.slot.shape[1], np.float32)
        row = longest.astype(np.int64) * CLASSES
        for k in range(len(ORDERS)):
            s += self.weights[:, k, :].ravel().take(row + gate[k]) * stretched[k]
        return np.clip(s, -14, 14), stretched, gate, longest.astype(np.int64)

    def refined(self, s: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixer's and the adaptive map's, between two buckets."""
        p = 1.0 / (1.0 + np.exp(-s))
        at = (s + 14) / 28 * (BUCKETS - 1)
        low = np.minimum(at.astype(np.int64), BUCKETS - 2)
        share = at - low
        centre = 1.0 / (1.0 + np.exp(-(np.arange(BUCKETS) / (BUCKETS - 1) * 28 - 14)))
        chance = ((self.seen[:, :, 1] + 8 * centre) / (self.seen.sum(axis=2) + 8)).ravel()
        cell = node * BUCKETS + low
        q = (1 - share) * chance.take(cell) + share * chance.take(cell + 1)
        return np.clip((p + q) / 2, 1e-6, 1 - 1e-6)

    def learn(self, words: list[bytes], counts: np.ndarray, rate: float = 0.02) -> None:
        """One online pass: gradient steps of the mixer and counts of the adaptive map, batch by batch."""
        square = np.full_like(self.weights, 1e-3)
        parts = list(batches_of(words, counts))
        for k in np.random.default_rng(1).permutation(len(parts)):  # neighbours in the alphabet are too much alike
            part, c, _ = parts[k]
            e = events(part)
            weight = prefix_weights(e, c)[e.byte]
            s, stretched, gate, longest = self.mixed(e, leave_out=True)
            error = (e.bit - 1.0 / (1.0 + np.exp(-s))) * weight / weight.sum() * 100
            step = np.zeros(self.weights.size)
            for k in range(len(ORDERS)):
                flat = (longest * len(ORDERS) + k) * CLASSES + gate[k]
                step += np.bincount(flat, error * stretched[k], self.weights.size)
            step = step.reshape(self.weights.shape)
            square += step * step
            self.weights += (rate * step / np.sqrt(square)).astype(np.float32)
            near = np.rint((s + 14) / 28 * (BUCKETS - 1)).astype(np.int64)
            flat = (e.node * BUCKETS + near) * 2 + e.bit
            self.seen += np.bincount(flat, weight, self.seen.size).reshape(self.seen.shape)

    def log10(self, words: list[bytes], leave_out: bool = False) -> np.ndarray:
        """log10 probability of each word with its closing blank; ``leave_out`` if training held each of them once."""
        out = np.zeros(len(words))
        for part, _, numbers in batches_of(words, np.zeros(len(words)), CODED_BYTES):
            e = events(part)
            p = self.refined(self.mixed(e, leave_out)[0], e.node)
            cost = np.bincount(e.byte, np.log10(np.where(e.bit == 1, p, 1 - p)), len(e.pos))
            upto = np.concatenate([[0.0], np.cumsum(cost)]).tolist()
            sizes = np.bincount(e.word, minlength=len(part)).tolist()
            path, at = [(0, 0.0, 0)], 0  # for each run of bytes on the way to a word: where it begins, the total before, its place in upto
            for number, keep, n in zip(numbers, e.shared.tolist(), sizes, strict=True):
                while path[-1][0] > keep:
                    path.pop()
                begin, total, first = path[-1]
                total += upto[first + keep - begin] - upto[first]
                path.append((keep, total, at))
                out[number] = total + upto[at + n] - upto[at]
                at += n
        return out


def add_events(zeros: np.ndarray, ones: np.ndarray, e: Events, counts: np.ndarray) -> None:
    weight = prefix_weights(e, counts)[e.byte].astype(zeros.dtype)
    for bit, table in ((0, zeros), (1, ones)):
        at = np.flatnonzero(e.bit == bit)
        w = weight[at]
        for k in range(len(ORDERS)):
            np.add.at(table, e.slot[k, at], w)


def summed(parts_of: DataFrame, size: int) -> np.ndarray:
    """Rows (chunk, counts) added up chunk by chunk; the table's size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpacked(p).astype(np.uint64) for p in table["counts"].to_pylist())
        return pa.table({"chunk": table["chunk"][:1].cast(pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    out = np.zeros(size, np.float32)
    for r in parts_of.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toLocalIterator():  # 8 * size bytes in all at most
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpacked(r["counts"])
    return out


def packed(counts: np.ndarray) -> bytes:
    """A chunk of whole numbers by the fewest bytes that hold its greatest."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // CHUNK}")


def chunks_of(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chunks that hold anything; a table's size is a multiple of the chunk's."""
    for k in range(0, len(counts), CHUNK):
        if counts[k : k + CHUNK].any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "counts": pa.array([packed(counts[k : k + CHUNK])], pa.binary())})


def fit_speller(words: DataFrame) -> Speller:
    """Train on a table (key) of distinct words, each counting once: slot counts, then mixer and map by averaged online passes.

    Words are dealt by a hash into parts of bounded size, and sorted in each, so that the
    model depends neither on the order nor on the partitions of the table.
    """
    spark = words.sparkSession
    n_parts = max(1, math.ceil(words.count() / TASK_WORDS))
    dealt = words.select("key", F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("int").alias("part"))

    def count(table: pa.Table) -> pa.Table:
        both = np.zeros(2 * SLOTS, np.uint32)
        own = [w.encode() for w in table["key"].to_pylist()]
        for part, c, _ in batches_of(own, np.ones(len(own))):
            add_events(both[:SLOTS], both[SLOTS:], events(part), c)
        return pa.Table.from_batches([*chunks_of(both)], pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    speller = Speller(*summed(dealt.groupBy("part").applyInArrow(count, "chunk int, counts binary"), 2 * SLOTS).reshape(2, SLOTS))
    sent = spark.sparkContext.broadcast(speller)

    def learn(table: pa.Table) -> pa.Table:
        model = sent.value.beginner()
        own = [w.encode() for w in table["key"].to_pylist()]
        model.learn(own, np.ones(len(own)))
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "weights": [model.weights.astype("<f4").tobytes()], "seen": [model.seen.astype("<f8").tobytes()], "total": [float(len(own))]})

    def together(table: pa.Table) -> pa.Table:
        """The maps of some parts added up, whole numbers in any order; their weights side by side."""
        seen = sum(np.frombuffer(x, "<f8") for x in table["seen"].to_pylist())
        return pa.table({"parts": [table["part"].to_numpy().astype("<i4").tobytes()], "totals": [table["total"].to_numpy().astype("<f8").tobytes()], "weights": [b"".join(table["weights"].to_pylist())], "seen": [seen.tobytes()]})

    learnt = dealt.groupBy("part").applyInArrow(learn, "part int, weights binary, seen binary, total double")
    seen, weights = np.zeros(speller.seen.shape), []
    for r in learnt.groupBy(F.col("part") % 16).applyInArrow(together, "parts binary, totals binary, weights binary, seen binary").collect():  # 2 kB of weights a part, 16 maps
        seen += np.frombuffer(r["seen"], "<f8").reshape(seen.shape)
        numbers = np.frombuffer(r["parts"], "<i4").tolist()
        weights += zip(numbers, np.frombuffer(r["totals"], "<f8").tolist(), np.frombuffer(r["weights"], "<f4").astype(np.float64).reshape(len(numbers), -1), strict=True)
    sent.destroy()
    if weights:
        mean = sum(w * n for _, n, w in sorted(weights, key=lambda x: x[0])) / sum(n for _, n, _ in weights)
        speller.weights, speller.seen = mean.reshape(speller.weights.shape).astype(np.float32), seen
    return speller


# -- words and phrases of a batch of texts -------------------------------------------------
def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | np.uint64(1)


@dataclass
class Words:
    """The words of some texts, A-Z in lower case: numbers of the distinct ones, one text after another."""

    number: np.ndarray
    distinct: pa.Array
    size: np.ndarray  # words of each text
    n_bytes: np.ndarray  # of the words of each text

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Parts texts at SPACES; a null text has no words."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        border = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(data)[border[0] : border[-1]] if data is not None else b""
        plain = np.frombuffer(bytes(raw).translate(PLAIN), np.uint8)
        border = border - border[0]
        inside = plain != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = border[:-1][border[:-1] < border[1:]]
        first[starts] = inside[starts]
        letters = plain[inside]
        start = np.flatnonzero(first[inside])
        upto = np.append(start, len(letters))
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(upto), pa.py_buffer(letters)).dictionary_encode()
        before = np.searchsorted(np.flatnonzero(first), border)
        return cls(words.indices.to_numpy().astype(np.int64), words.dictionary, np.diff(before), np.diff(upto[before]))

    def batches(self) -> Iterator[np.ndarray]:
        """Numbers of texts of like length that hold a bounded number of tokens together, or of one text."""
        order = np.argsort(self.size, kind="stable")
        total = np.cumsum(self.size[order] + 1)
        begin, before = 0, 0
        while begin < len(order):
            end = max(begin + 1, int(np.searchsorted(total, before + BATCH_TOKENS, "right")))
            yield order[begin:end]
            begin, before = end, int(total[end - 1])


def phrases(h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases of texts, from the hashes of their words and a mark at the last word of each."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.flatnonzero(((h >> np.uint64(40)) % np.uint64(ANCHOR) == 0) | last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    times = -(-(ends - starts) // LONGEST_PHRASE)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts = np.repeat(starts, times) + k * LONGEST_PHRASE
    size = np.diff(np.append(starts, len(h)))
    power = np.cumprod(np.full(LONGEST_PHRASE, _P), dtype=np.uint64)
    place = np.arange(len(h)) - np.repeat(starts, size)
    total = np.add.reduceat(h * power[place], starts) ^ size.astype(np.uint64)
    total = (total ^ (total >> np.uint64(31))) * _C
    return starts, total ^ (total >> np.uint64(29))


def phrase_key(h: int) -> str:
    """Begins with a blank, as no word does."""
    return f" {h:016x}"


@dataclass
class Batch:
    """The tokens of some texts one after another, each text closed by its end."""

    number: np.ndarray  # of each word
    place: np.ndarray  # of each word among the tokens
    text: np.ndarray  # of each token
    first: np.ndarray  # token at which each text begins
    size: np.ndarray  # words of each text

    @classmethod
    def of(cls, numbers: list[np.ndarray]) -> Batch:
        return cls.along(np.concatenate([np.zeros(0, np.int64), *numbers]), np.array([len(n) for n in numbers], np.int64))

    @classmethod
    def along(cls, number: np.ndarray, size: np.ndarray) -> Batch:
        return cls(number, np.arange(len(number)) + np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), size + 1), np.cumsum(size + 1) - size - 1, size)

    def last(self) -> np.ndarray:
        """Marks the last word of each text."""
        out = np.zeros(len(self.number), bool)
        out[np.cumsum(self.size)[self.size > 0] - 1] = True
        return out

    def spread(self, values: np.ndarray, end) -> np.ndarray:
        """Values of words as values of tokens."""
        out = np.full(len(self.text), end, values.dtype)
        out[self.place] = values
        return out

    def contexts(self, symbol: np.ndarray) -> np.ndarray:
        """Hashes of the leaf before and of the two leaves before each token; where no word was it is 0."""
        token = symbol.astype(np.uint64) + np.uint64(1)
        one, two = np.zeros_like(token), np.zeros_like(token)
        one[1:], two[2:] = token[:-1], token[:-2]
        one[self.first] = two[self.first] = 0
        two[self.first[self.size > 0] + 1] = 0
        return np.stack([(one + np.uint64(1)) * _C, ((one + np.uint64(7)) * _P + two) * _C])


# -- the tree of frequent words ---------------------------------------------------------------
def gates() -> np.ndarray:
    """First weights by how often the two hashed contexts were met (never, once or twice, up to 15 times, more): the longer ones go first."""
    trust = (0.0, 0.3, 0.6, 0.85)
    return np.array([[(1 - b) * (1 - a), (1 - b) * a, b] for a in trust for b in trust], np.float32)


@dataclass
class Tree:
    """Leaves for the end, the escape and frequent words, by a Huffman code of their training counts."""

    words: list[str]
    counts: np.ndarray  # of the end, the escape and the words
    number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {w: k + 2 for k, w in enumerate(self.words)}
        heap = [(float(c) + 0.5, k) for k, c in enumerate(self.counts)]
        n, below = len(heap), {}
        heapq.heapify(heap)
        total = {k: c for c, k in heap}
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            node = n + len(below)
            below[node], total[node] = (x, y), a + b
            heapq.heappush(heap, (a + b, node))
        self.stretched = np.zeros(max(1, len(below)), np.float32)
        ways: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        todo = [(heap[0][1], [])]
        while todo:
            at, way = todo.pop()
            if at < n:
                ways[at] = way
                continue
            zero, one = below[at]
            self.stretched[at - n] = math.log(total[one] / total[zero])
            todo += [(zero, [*way, (at - n, 0)]), (one, [*way, (at - n, 1)])]
        self.length = np.array([len(w) for w in ways], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([x for w in ways for x, _ in w], np.int32)
        self.bit = np.array([x for w in ways for _, x in w], np.int8)

    def symbols(self, words: list[str]) -> np.ndarray:
        """Leaves of words, or the escape."""
        return np.fromiter(map(self.number.get, words, repeat(ESCAPE)), np.int64, len(words))

    def bits(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The coded bits of symbols: number of the symbol's token, node and bit."""
        length = self.length[symbol]
        token = np.repeat(np.arange(len(symbol)), length)
        at = np.arange(len(token)) + np.repeat(self.start[symbol] - np.cumsum(length) + length, length)
        return token, self.node[at], self.bit[at]


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (((context ^ (node.astype(np.uint64) * _P)) * _C) >> np.uint64(64 - CONTEXT_BITS)).view(np.int64)


def add_contexts(table: np.ndarray, tree: Tree, batch: Batch) -> None:
    """Count the bits of all tokens in their slots; the batch's numbers are leaves."""
    symbol = batch.spread(batch.number, END)
    contexts = batch.contexts(symbol)
    for begin in range(0, len(symbol), BATCH_TOKENS):
        part = slice(begin, begin + BATCH_TOKENS)
        token, node, bit = tree.bits(symbol[part])
        for k in range(CONTEXTS):
            np.add.at(table, (k << (CONTEXT_BITS + 1)) + 2 * slots(contexts[k][part][token], node) + bit, np.uint32(1))


def count_contexts(docs: DataFrame, tree) -> np.ndarray:
    """Zeros and ones met in every slot of both hashed contexts along all training texts."""
    size = CONTEXTS << (CONTEXT_BITS + 1)

    def run(batches):
        hold(None)
        t, table = tree.value, np.zeros(size, np.uint32)
        for b in batches:
            for part in slices(b, 0):
                words = Words.of(part.column(0))
                add_contexts(table, t, Batch.along(t.symbols(strings(words.distinct))[words.number], words.size))
        yield from chunks_of(table)

    return summed(docs.where("own").select("text").mapInArrow(run, "chunk int, counts binary"), size)


class Mixer:
    """Codes the tree bits of texts: weights and an adaptive map for each text, refined along it."""

    def __init__(self, tree: Tree, counts: np.ndarray) -> None:
        self.tree = tree
        self.counts = counts.reshape(CONTEXTS, -1, 2)
        centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) / (BUCKETS - 1) * 24 - 12)))
        self.map = PRIOR * np.stack([1 - centre, centre], axis=1)

    def __getstate__(self) -> tuple:
        return self.tree, shrunk(self.counts)

    def __setstate__(self, state: tuple) -> None:
        self.__init__(state[0], restored(*state[1]).astype(np.float32))

    def costs(self, batch: Batch, symbol: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits of every token; ``own`` marks texts that the counts include.

        Block by block of each text, all texts of the batch side by side: what one text
        learns no other one sees.
        """
        n = len(batch.size)
        weights = np.repeat(gates().T[:, None], n, axis=1).reshape(CONTEXTS + 1, -1)  # of each text and gate
        squares = np.ones(weights.shape)
        seen = np.repeat(self.map[None], n, axis=0).reshape(-1, 2)
        pairs = [c.view(np.int64).ravel() for c in self.counts]  # both counts of a slot are read at once
        contexts = batch.contexts(symbol)
        out = np.zeros(len(symbol))
        block = (np.arange(len(symbol)) - batch.first[batch.text]) // BLOCK
        order = np.argsort(block, kind="stable")
        borders = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        half, top = np.float32((BUCKETS - 1) / 24), np.float32((BUCKETS - 1) / 2)
        for begin, end in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            at = order[begin:end]
            token, node, bit = self.tree.bits(symbol[at])
            if not len(token):
                continue
            text = batch.text[at][token]
            one = bit.astype(np.float32)
            mine = own[text].astype(np.float32)
            in_ones = mine * one
            in_zeros = mine - in_ones
            stretched, gate = [self.tree.stretched.take(node)], np.zeros(len(token), np.int8)
            for k in range(CONTEXTS):
                met = pairs[k].take(slots(contexts[k][at][token], node)).view(np.float32)
                a, b = met[0::2] - in_zeros, met[1::2] - in_ones
                np.maximum(a, 0, out=a)
                np.maximum(b, 0, out=b)
                total = a + b
                gate *= 4
                gate += (total > 0).view(np.int8) + (total > 2).view(np.int8) + (total > 15).view(np.int8)
                a += np.float32(SMALL)
                b += np.float32(SMALL)
                b /= a
                stretched.append(np.log(b, out=b))
            cell = 16 * text + gate
            s = weights[0].take(cell) * stretched[0]
            for k in range(1, CONTEXTS + 1):
                s += weights[k].take(cell) * stretched[k]
            np.clip(s, -12, 12, out=s)
            p = 1 / (1 + np.exp(-s))
            near = BUCKETS * text + np.rint(s * half + top).astype(np.int64)
            chance = (seen[:, 1] / (seen[:, 0] + seen[:, 1])).astype(np.float32)
            refined = np.clip((p + chance.take(near)) / 2, np.float32(1e-6), np.float32(1 - 1e-6))
            wrong = one - p
            out[at] = np.bincount(token, -np.log2(np.abs(1 - one - refined)), len(at))
            for k, x in enumerate(stretched):
                step = np.bincount(cell, wrong * x, 16 * n)
                squares[k] += step * step
                weights[k] += RATE * step / np.sqrt(squares[k])
            seen += np.bincount(2 * near + bit, minlength=seen.size).reshape(seen.shape)
        return out


# -- scoring --------------------------------------------------------------------------------
@dataclass
class Corpus:
    """What is broadcast of a training corpus; its size is bounded by KNOWN_WORDS and the tables'."""

    mixer: Mixer
    speller: Speller
    known: dict[str, int]  # counts of the most frequent words
    tokens: int
    distinct: int
    ends: int
    escaped: int  # training tokens that are no leaf
    new: float  # chance that an escaped token is a new word
    phrases: int


class GroupScorer:
    """Scores the texts of a group.

    ``counts`` has the corpus counts of the group's words and phrases, but for the most
    frequent words and for those that occur nowhere but at one place of a training text, or
    in no training text at all.
    """

    def __init__(self, corpus: Corpus, counts: dict[str, int]) -> None:
        self.corpus, self.counts = corpus, counts

    def looked_up(self, words: Words, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Leaf, count, spelling cost and hash of each distinct word; ``mine`` marks words of training texts."""
        c, own = self.corpus, strings(words.distinct)
        trained = np.zeros(len(own), bool)
        trained[words.number[mine]] = True
        n = np.fromiter(map(c.known.get, own, repeat(0)), np.int64, len(own))
        symbol = np.full(len(own), ESCAPE)
        often = np.flatnonzero(n)
        symbol[often] = c.mixer.tree.symbols([own[k] for k in often.tolist()])
        seldom = np.flatnonzero(n == 0)
        n[seldom] = np.fromiter(map(self.counts.get, [own[k] for k in seldom.tolist()], repeat(-1)), np.int64, len(seldom))
        n = np.where(n < 0, trained, n)
        spelled = np.zeros(len(own))
        for once in (False, True):  # a word that training held once is left out of the speller's counts
            which = np.flatnonzero((symbol == ESCAPE) & (n == once) & (trained | (not once))).tolist()
            if which:
                spelled[which] = c.speller.log10([own[k].encode() for k in which], leave_out=once)
        return symbol, n, spelled, word_hashes(own)

    def score(self, words: Words, own: np.ndarray) -> dict[str, np.ndarray]:
        """Sums of each text; ``own`` marks training texts."""
        c = self.corpus
        symbols, counts, spelled, hashes = self.looked_up(words, np.repeat(own, words.size))
        shares = np.log10((counts + 1) / (c.tokens + c.distinct + 1))
        first = np.cumsum(words.size) - words.size
        known, base, bits = np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(len(own))
        for which in words.batches():
            batch = Batch.of([words.number[a : a + n] for a, n in zip(first[which].tolist(), words.size[which].tolist(), strict=True)])
            at, k = batch.number, len(which)
            of_word = np.repeat(np.arange(k), batch.size)
            mine = own[which][of_word]
            n, symbol = counts[at], symbols[at]
            cost = c.mixer.costs(batch, batch.spread(symbol, END), own[which])
            ends = cost[batch.first + batch.size]
            cost = cost[batch.place]
            elsewhere = n - mine
            escaped = symbol == ESCAPE
            met = escaped & (elsewhere > 0)
            new = escaped & (elsewhere <= 0)
            cost[met] -= np.log2((1 - c.new) * elsewhere[met] / max(c.escaped, 1))
            cost[new] -= math.log2(c.new) + spelled[at[new]] * math.log2(10)
            known[which] = np.bincount(of_word, n > 0, k)
            base[which] = np.bincount(of_word, shares[at], k)
            bits[which] = self.by_phrase(batch, hashes[at], cost, own[which]) + ends
        return {
            "n_tokens": words.size + 1,
            "n_known": known + (c.ends > 0),
            "base_score": base + math.log10((c.ends + 1) / (c.tokens + c.distinct + 1)),
            "bits": bits,
            "n_bytes": words.n_bytes + words.size + 1,
        }

    def by_phrase(self, batch: Batch, h: np.ndarray, cost: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits of each text's words, where phrases that occur elsewhere may be coded as wholes."""
        starts, hashes = phrases(h, batch.last())
        size = np.diff(np.append(starts, len(h)))
        plain = np.bincount(np.repeat(np.arange(len(starts)), size), cost, len(starts))
        text = np.repeat(np.arange(len(batch.size)), batch.size)[starts]
        get = self.counts.get
        elsewhere = np.fromiter((get(phrase_key(x), 0) for x in hashes.tolist()), np.int64, len(starts)) - own[text]
        miss = -math.log2(1 - SELDOM)
        bits = np.bincount(text, plain + miss, len(batch.size))
        for k in np.unique(text[elsewhere > 0]).tolist():
            lo, hi = np.searchsorted(text, [k, k + 1])
            bits[k] = self.along(plain[lo:hi].tolist(), elsewhere[lo:hi].tolist())
        return bits

    def along(self, plain: list[float], elsewhere: list[int]) -> float:
        total, chance = 0.0, SELDOM
        for bits, n in zip(plain, elsewhere, strict=True):
            if n > 0:
                whole, words = chance * n / self.corpus.phrases, (1 - chance) * 2.0**-bits
                total -= math.log2(whole + words)
                chance = SELDOM + (AGAIN - SELDOM) * whole / (whole + words)
            else:
                total += bits - math.log2(1 - chance)
                chance = SELDOM
        return total


def group_numbers(docs: DataFrame, n: int, *columns: str) -> Column:
    """Group of each row among n, by a hash of some columns, numbered so that ``repartition(n, group)`` gives each its own partition.

    Of very many groups the numbers are plain, and a partition gets one on average.
    """
    index = F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    if n > 4096:
        return index
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
    first = docs.sparkSession.range(100 * n).select("id", place).groupBy("place").agg(F.min("id").alias("number")).collect()
    number = {r["place"]: r["number"] for r in first}
    return F.get(F.array(*(F.lit(number.get(k, k)).cast("int") for k in range(n))), index)


def group_counts(rows: DataFrame, n_groups: int) -> DataFrame:
    """(grp, key, n, others): occurrences in a group's training and other texts of words, of phrases and, under '', of ends."""

    def run(batches):
        hold(None)
        tallies: dict[int, Tally] = {}
        for b in batches:
            for part in slices(b, 2):
                group, own = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                for g in np.unique(group).tolist():
                    at = np.flatnonzero(group == g)
                    texts = part.column(2) if len(at) == len(group) else part.column(2).take(pa.array(at))
                    tallies.setdefault(g, Tally()).add(Words.of(texts), own[at])
                if sum(t.held for t in tallies.values()) > 2 * HELD_WORDS:
                    for t in tallies.values():
                        t.merge()
                    if sum(t.held for t in tallies.values()) > HELD_WORDS:
                        for g, t in tallies.items():
                            yield from t.rows(g)
                        tallies.clear()
        for g, t in tallies.items():
            yield from t.rows(g)

    return rows.select("grp", "own", "text").repartition(n_groups, "grp").mapInArrow(run, "grp int, key string, n long, others long")


class Tally:
    """Counts of the words and phrases of some texts of one group."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.counts: list[np.ndarray] = []  # in training texts, in others
        self.phrases: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.ends = np.zeros(2, np.int64)
        self.held = 0

    def add(self, words: Words, own: np.ndarray) -> None:
        self.ends += [own.sum(), (~own).sum()]
        mine = np.repeat(own, words.size)
        self.words.append(words.distinct)
        self.counts.append(np.stack([np.bincount(words.number[which], minlength=len(words.distinct)) for which in (mine, ~mine)]))
        self.held += len(words.distinct)
        starts, hashes = phrases(word_hashes(strings(words.distinct))[words.number], Batch.along(words.number, words.size).last())
        self.phrases.append(hashes)
        self.marks.append(mine[starts])

    def merge(self) -> None:
        """Each word once."""
        words = pa.concat_arrays([pa.array([], pa.large_string()), *self.words]).dictionary_encode()
        counts = np.concatenate([np.zeros((2, 0), np.int64), *self.counts], axis=1)
        at = words.indices.to_numpy()
        self.words, self.held = [words.dictionary], len(words.dictionary)
        self.counts = [np.stack([np.bincount(at, c, self.held) for c in counts]).astype(np.int64)]

    def rows(self, group: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        hashes, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.phrases]), return_inverse=True)
        marks = np.concatenate([np.zeros(0, bool), *self.marks])
        keys = pa.concat_arrays([pa.array([""], pa.large_string()), *self.words, pa.array(map(phrase_key, hashes.tolist()), pa.large_string())])
        n, others = (np.concatenate([self.ends[k : k + 1], self.counts[0][k], np.bincount(at[which], minlength=len(hashes))]).astype(np.int64) for k, which in enumerate((marks, ~marks)))
        for k in range(0, len(keys), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_pydict({"grp": pa.array(np.full(len(keys[part]), group), pa.int32()), "key": keys[part].cast(pa.string()), "n": pa.array(n[part]), "others": pa.array(others[part])})


def score_documents(
    docs: DataFrame,
    held_out: int = 2,
    modulus: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores of every whole text by an add-one word model and by context mixing.

    Learns from the texts whose crc32(id as text) modulo ``modulus`` is not ``held_out``
    (a null id counts as training).  n_tokens counts words and one end, n_known those seen
    in training, train_tokens all of training; base_score sums log10((c+1)/(N+(V+1))) over
    tokens; score is the mixing model's log10 probability of the same tokens, and
    bits_per_byte its code length over the bytes of words with one blank or end each.

    Texts are dealt into groups by a hash.  A group's words and phrases meet their corpus
    counts by a join on the word, but for the most frequent words, whose counts are broadcast
    (at most KNOWN_WORDS), so no join key is hot; then its texts pass by, one after another.
    The usual edge cases; an empty text is its end alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark)
    own = F.coalesce(crc_mod(id_col, modulus), F.lit(-1)) != held_out
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n_groups = 1 + int(size) // GROUP_BYTES
    group = group_numbers(docs, n_groups, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own.alias("own"), group.alias("grp"))

    # what the corpus holds
    pairs = tables.keep(group_counts(rows, n_groups))
    vocabulary = tables.keep(pairs.groupBy("key").agg(F.sum("n").alias("n"), F.max("others").alias("others")))
    phrase = F.col("key").startswith(" ")
    word = ~phrase & (F.col("key") != "")
    total = lambda where, what=F.col("n"): F.coalesce(F.sum(F.when(where, what)), F.lit(0))
    words, ends, n_phrases, distinct, once = vocabulary.agg(total(word), total(F.col("key") == ""), total(phrase), total(~phrase & (F.col("n") > 0), F.lit(1)), total(word & (F.col("n") == 1))).first()
    least = max(1, -(-int(words) // KNOWN_WORDS))
    often = vocabulary.where(word & (F.col("n") > least)).orderBy(F.desc("n"), "key")
    known = {r["key"]: r["n"] for r in often.collect()}  # at most KNOWN_WORDS
    leaves = list(known)[:TREE_WORDS]
    escaped = int(words) - sum(known[w] for w in leaves)
    tree = Tree(leaves, np.array([ends, escaped, *(known[w] for w in leaves)], np.float64))

    # the models
    speller = fit_speller(vocabulary.where(word & (F.col("n") > 0)))
    sent_tree = spark.sparkContext.broadcast(tree)
    counts = count_contexts(rows, sent_tree)
    sent_tree.destroy()
    new = (int(once) + 1) / (escaped + 2)
    corpus = spark.sparkContext.broadcast(Corpus(Mixer(tree, counts), speller, known, int(words) + int(ends), int(distinct), int(ends), escaped, new, int(n_phrases)))

    # each group's counts before its texts; what occurs at one place alone, or in no training text, needs none
    frequent = F.broadcast(often.select("key"))
    table = vocabulary.where((word & (F.col("n") <= least)) | phrase).where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("others") > 0))).select("key", "n")
    wanted = pairs.select("grp", "key").join(frequent, "key", "left_anti").join(table, "key")
    id_type = rows.schema["id"].dataType
    both = wanted.select("grp", F.lit(0).alias("kind"), F.col("key").alias("body"), "n", F.lit(None).cast(id_type).alias("id"), F.lit(False).alias("own"))
    both = both.unionByName(rows.select("grp", F.lit(1).alias("kind"), F.col("text").alias("body"), F.lit(None).cast("long").alias("n"), "id", "own"))
    full = StructType([StructField("id", id_type), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, bits double, n_bytes long").fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        hold(None)
        at, held = None, {}
        for b in batches:
            for part in slices(b, 2):
                group, kind = part.column(0).to_numpy(), part.column(1).to_numpy()
                borders = np.flatnonzero(np.diff(2 * group.astype(np.int64) + kind, prepend=-1, append=-1))
                for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    run_of = part.slice(lo, hi - lo)
                    if group[lo] != at:
                        at, held = group[lo], {}
                    if kind[lo] == 0:
                        held.update(zip(strings(run_of.column(2)), run_of.column(3).to_numpy(zero_copy_only=False).tolist(), strict=True))
                        continue
                    mine = run_of.column(5).to_numpy(zero_copy_only=False)
                    got = GroupScorer(corpus.value, held).score(Words.of(run_of.column(2)), mine)
                    cols = [run_of.column(4).cast(arrow.field(0).type), pa.array(~mine), *(pa.array(got[f.name], f.type) for f in list(arrow)[2:])]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    done = both.repartition(n_groups, "grp").sortWithinPartitions("grp", "kind").mapInArrow(run, full)
    return done.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(words) + int(ends)).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("bits") * -math.log10(2)).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
