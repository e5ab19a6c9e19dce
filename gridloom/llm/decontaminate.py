"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over a window of words; words at its zeros are ignored, so a
substituted word does not break the hash of a window.  Hashes of all windows of the
documents are looked up among those of the benchmark; around each hit the item is laid
along the document and the best overlap, with substitutions, is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import Memo, filter_texts, parts, prepare

#: Fixed masks: each has six compared positions, laid out so that close substitutions spoil few of them.
MASKS = ("1110111", "11011011", "110100111", "1011001101", "11100010011")
#: Words of a benchmark block: what one broadcast holds at most, give or take one item.
BLOCK_WORDS = 2_000_000
#: Diagonals of one document that are remembered as verified.
SEEN = 500_000
_MARKS = re.compile(r"[\W_]+")


def word_number(word: str) -> int:
    """64-bit hash of a word without case and marks; 0 for a word of marks only."""
    w = _MARKS.sub("", word).lower()
    return xxhash.xxh3_64_intdigest(w) >> 1 or 1 if w else 0


class WordNumbers:
    """The numbers of a text's words; words of marks only vanish."""

    def __init__(self, kept: int = 200_000) -> None:
        self.known = Memo(word_number, kept)

    def of(self, text: str) -> np.ndarray:
        known = self.known
        h = np.array([known[w] for w in text.split()], np.uint64)
        return h[h > 0]


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window start, of the words at the ones of the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


@dataclass
class Seeds:
    """A block of benchmark items with the index of their spaced-seed hashes."""

    ids: list
    words: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray  # sorted
    places: np.ndarray  # item and offset of each hash
    bitmap: np.ndarray

    @classmethod
    def build(cls, items: list[tuple]) -> Seeds:
        numbers = WordNumbers()
        ids = [i for i, _ in items]
        words = [numbers.of(t or "") for _, t in items]
        shortest = min(map(len, MASKS))
        masks = [*MASKS, *("1" * n for n in sorted({len(w) for w in words if 0 < len(w) < shortest}))]
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for mask in masks:
            for k, w in enumerate(words):
                if (len(w) < shortest) != (mask not in MASKS) or (mask not in MASKS and len(w) != len(mask)):
                    continue  # an item too short for the masks has one seed, of all its words
                h = window_hashes(w, mask)
                hashes.append(h)
                places.append(np.stack([np.full(len(h), k), np.arange(len(h))], axis=1))
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        bitmap = np.zeros(1 << 22, bool)
        bitmap[h >> np.uint64(42)] = True
        return cls(ids, words, masks, h[order], p[order], bitmap)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start of the item along the document) of all seed hits; the start may be negative.

        A pair comes once, or again after SEEN others: what is remembered of a repetitive
        text against many alike items stays bounded.
        """
        seen: set[tuple[int, int]] = set()
        for mask in self.masks:
            h = window_hashes(words, mask)
            at = np.flatnonzero(self.bitmap[h >> np.uint64(42)])
            if not len(at):
                continue
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for pos, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for item, offset in self.places[a:b].tolist():
                    if (pair := (item, pos - offset)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(pair)
                        yield pair

    def verify(self, words: np.ndarray, item: int, start: int, least_words: int, least_share: float) -> tuple[int, int, int]:
        """Best overlap on one diagonal: (equal words, length, document word at which it begins).

        The segment of greatest sum with +1 for an equal word and a penalty for a substituted
        one that makes any share of equal words below ``least_share`` lose.  If that has fewer
        than ``least_words`` equal words, the segment of most equal words whose sum isn't
        negative: to each end belongs the earliest begin whose prefix sum isn't above its own.
        """
        own = self.words[item]
        a, b = max(0, -start), min(len(own), len(words) - start)
        same = own[a:b] == words[start + a : start + b]
        if same.sum() < least_words:
            return 0, 0, start + a
        gain = np.where(same, 1.0, -least_share / (1.0 - least_share))
        total = np.concatenate([[0.0], np.cumsum(gain)])
        floor = np.minimum.accumulate(total)
        end = int(np.argmax(total - floor))
        begin = int(np.flatnonzero(total[: end + 1] == floor[end])[0])
        if same[begin:end].sum() < least_words:
            begins = np.searchsorted(-floor, -total - 1e-9)
            equal = np.concatenate([[0], np.cumsum(same)])
            end = int(np.argmax(equal - equal[begins]))
            begin = int(begins[end])
            begin += int(np.argmax(same[begin:end]))  # substituted words at its begin don't belong to it, and argmax leaves none at its end
        return int(same[begin:end].sum()), end - begin, start + a + begin

    def overlaps(self, words: np.ndarray, least_words: int, least_share: float) -> Iterator[tuple[int, int, int, int]]:
        """(item, equal words, length, begin) of each verified diagonal."""
        for item, start in self.hits(words):
            least = min(least_words, len(self.words[item]))
            same, length, at = self.verify(words, item, start, least, least_share)
            if same >= least and same >= least_share * length - 1e-9:
                yield item, same, length, at

    def found(self, words: np.ndarray, least_words: int, least_share: float) -> dict[int, tuple[int, int, int]]:
        """Best verified overlap of each item that the document holds."""
        out: dict[int, tuple[int, int, int]] = {}
        for item, same, length, at in self.overlaps(words, least_words, least_share):
            out[item] = max(out.get(item, (0, 0, 0)), (same, -length, -at))
        return {k: (same, -length, -at) for k, (same, length, at) in out.items()}

    def any(self, words: np.ndarray, least_words: int, least_share: float) -> bool:
        return next(self.overlaps(words, least_words, least_share), None) is not None


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // (5 * block_words)
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        if rows := [(r[0], r[1]) for r in part.collect()]:
            yield sorted(rows, key=lambda r: (r[0] is None, r))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least_words: int = 10,
    least_share: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and benchmark item that it overlaps.

    An overlap has at least ``least_words`` equal words (or the whole item, if shorter) and
    a share of equal words of at least ``least_share``; n_equal and n_words measure the best
    one, which begins at word ``at`` of the document's marks-free words.  Benchmarks of any
    size are taken in broadcast blocks of bounded size, each against all documents.
    The usual edge cases; empty texts and items overlap nothing.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"))
    full = StructType([StructField(id_col, source.schema["id"].dataType), StructField(item_col, bench.schema["item"].dataType), *StructType.fromDDL("n_equal long, n_words long, at long").fields])
    arrow = to_arrow_schema(full)
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds.build(items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds, numbers = sent.value, WordNumbers()
            for b in batches:
                for part, texts in parts(b, 1):
                    rows, at = [], []
                    for k, t in enumerate(texts):
                        for item, best in sorted(seeds.found(numbers.of(t), least_words, least_share).items()):
                            rows.append((seeds.ids[item], *best))
                            at.append(k)
                    ids = part.column(0).take(pa.array(at, pa.int64())).cast(arrow.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(arrow)[1:]))], schema=arrow)

        got = source.mapInArrow(run, full)
        out = got if out is None else out.unionAll(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], full)


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least_words: int = 10,
    least_share: float = 0.7,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of the documents that overlap no benchmark item; see find_leaks."""
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds.build(items))

        def make(sent=sent):
            seeds, numbers = sent.value, WordNumbers()
            return lambda texts: [not seeds.any(numbers.of(t), least_words, least_share) for t in texts]

        docs = filter_texts(docs, make, text_col)
    return docs
