"""Near-duplicate documents: fast similarity sketching, banding and exact verification.

Outline, all in tables:

1. Each text becomes its shingle set, and the set a sketch of fixed length.  Equal sets form
   a class, numbered by the digest of the set; one text of each class goes on.
2. Bands of the sketch are bucket keys.  In each bucket the class that meets most others is
   the pivot; every member is verified against it on the full sets.  This is linear in the
   bucket's size and joins most of a group of near copies at once.
3. Buckets that still hold several components are compared in blocks of bounded size:
   pairs of different components whose sizes and parity sketches allow the similarity
   are verified on the full sets as well; both bounds are sure.  A pair is taken in its first
   common band only.
4. Components of all verified links, mapped back to documents, give the result.

Nothing is capped: blocks bound the size of a task, not the pairs that are considered.
Full sets meet in parts that are dealt by the hash of a pair's second class; a class that
many pairs share is sent once to each part, so that no part depends on a group's size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridloom.llm.common import Memo, Tables, ascii_lower, map_texts, words_of
from gridloom.llm.components import connected_components

#: Banding sketch: coordinates of 16 bits, four to a band.  A pair of similarity 0.8 misses
#: all 32 bands with probability 5e-8.
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Bins of a parity sketch: the least power of two that is twice the set's size, within these.
FEWEST, MOST = 1 << 11, 1 << 16
#: Members of a block; shingles of the sets that meet in one verifying task, about.
BLOCK, PART_SHINGLES = 384, 2_000_000
#: Share of the entries of all shared buckets from which a bucket counts as crowded: there are fewer of these than its inverse.
CROWDED = 1 / 1000
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _D
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, width: int, kept: int = 200_000) -> None:
        self.width = width
        self.known = Memo(lambda w: xxhash.xxh3_64_intdigest(ascii_lower(w)), kept)

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        h = np.array([known[w] for w in words_of(text)], np.uint64)
        if not len(h):
            return h
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = (out ^ h[j : len(h) - k + 1 + j]) * _C
            out ^= out >> np.uint64(29)
        return np.unique(mix(out))


def class_of(s: np.ndarray) -> int | None:
    """The number of a set's class: 64 bits of its digest, as many as each shingle has."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


@lru_cache(maxsize=4)
def round_seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _C + np.uint64(t))


def similarity_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch: t coordinates of a non-empty set, each surely filled.

    In round i every element draws a bin and a value i + u with u in [0, 1); each bin keeps
    the least value.  The first t rounds draw the bin at random; round t + b puts all
    elements into bin b, so that after 2t rounds no bin is empty.  Rounds end once all bins
    are filled.  Later rounds have greater values and never change a filled bin, so several
    rounds can be drawn at once.
    """
    seeds = round_seeds(t)
    shift = np.uint64(64 - t.bit_length() + 1)
    sketch = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 2 * t // len(elements))
    i = 0
    while i < 2 * t:
        rounds = np.arange(i, min(2 * t, i + step))
        h = mix(elements[None, :] ^ seeds[rounds][:, None])
        bins = np.where((rounds < t)[:, None], (h >> shift).astype(np.int64), (rounds - t)[:, None])
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))
        value, bins = value.ravel(), bins.ravel()
        order = np.argsort(value)[::-1]  # the last of equal bins, the least, stays
        least = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        least[bins[order]] = value[order]
        np.minimum(sketch, least, out=sketch)
        i += step
        if sketch.max() != np.iinfo(np.uint64).max:
            break
    return sketch


def banding_sketch(s: np.ndarray) -> bytes:
    return (mix(similarity_sketch(s, COORDINATES)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def fine_sketch(s: np.ndarray) -> bytes:
    """Parity sketch: whether the number of shingles is odd, for each bin of their low bits.

    Shingles of both sets cancel, so two sketches of equal length differ in at most as many
    bits as the sets do in shingles: a bound that never fails.  Halves laid over each other
    by exclusive or are the sketch of half as many bins.
    """
    bins = min(MOST, max(FEWEST, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The words of each parity sketch, and for each length that occurs all sketches folded to it; shorter ones are left zero."""
    own = [np.frombuffer(f, np.uint64) for f in sketches]
    length = np.array([len(f) for f in own], np.int64)
    levels = {}
    for w in np.unique(length).tolist():
        levels[w] = np.zeros((len(own), w), np.uint64)
        for k in np.flatnonzero(length >= w).tolist():
            levels[w][k] = np.bitwise_xor.reduce(own[k].reshape(-1, w), axis=0)
    return length, levels


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """id, place (hash of id and text), n_shingles, and rep (the class) and bands, both null for an empty set."""

    def make():
        shingles = Shingler(width)

        def apply(texts: list[str]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "rep": [class_of(s) for s in sets],
                "bands": [np.frombuffer(banding_sketch(s), "<i8") if len(s) else None for s in sets],
            }

        return apply

    return map_texts(docs, make, "n_shingles long, rep long, bands array<long>", "id", "text", ("place",))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """rep and the full shingle set of non-empty texts."""

    def make():
        shingles = Shingler(width)

        def apply(texts: list[str]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            return {"rep": [class_of(s) for s in sets], "members": [s.tobytes() for s in sets]}

        return apply

    return map_texts(docs, make, "rep long, members binary", "id", "text").drop("id").where("rep is not null")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """rep and the parity sketch."""

    def run(batches):
        for b in batches:
            own = [np.frombuffer(m.as_py(), np.uint64) for m in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fine_sketch, own), pa.binary())], ["rep", "fine"])

    return sets.select("rep", "members").mapInArrow(run, "rep long, fine binary")


def sifted(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose place may be among those of keys (left_semi), or surely is not (left_anti).

    A bit stands for each place, in 2^18 numbers that are broadcast: texts need not be
    shuffled to find that they are not meant.  Of more places more pass; an exact join follows.
    """
    word, bit = F.expr("shiftrightunsigned(place, 46)"), F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(bits), (word == F.col("word")) & (bit.bitwiseAND(F.col("bits")) != 0), how)


def by_bucket(entries: DataFrame, buckets: DataFrame, least: float) -> DataFrame:
    """Join entries (band, value, n, ...) with rows of their buckets; those of the few crowded ones are broadcast, so no join key is hot."""
    keys = ["band", "value", "n"]
    crowded = entries.where(F.col("n") > least).join(F.broadcast(buckets.where(F.col("n") > least)), keys)
    return crowded.unionByName(entries.where(F.col("n") <= least).join(buckets.where(F.col("n") <= least), keys))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    part = F.pmod(F.xxhash64("b"), F.lit(n_parts)).cast("int").alias("part")
    dealt = pairs.select("a", "b", part)
    wanted = dealt.select("part", F.explode(F.array("a", "b")).alias("rep")).distinct()
    there = wanted.join(sets.select("rep", "members"), "rep").select(F.col("part").alias("to"), "rep", "members")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {r: np.frombuffer(m, np.uint64) for r, m in zip(right["rep"].to_pylist(), right["members"].to_pylist(), strict=True)}
        out_a, out_b = [], []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            x, y = own[a], own[b]
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < percent * len(y):
                continue
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                out_a.append(a)
                out_b.append(b)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("part").cogroup(there.groupBy("to")).applyInArrow(run, "a long, b long")


def block_pairs(percent: int):
    """Candidate pairs of one block pair: different components, first common band, sizes and parities allow it.

    100 * intersection >= percent * union means that the sets differ in at most
    (100 - percent) / (100 + percent) of the sum of their sizes, and no fewer shingles than
    bits differ; so no pair that links is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp, block, size = (np.array(table[c].to_pylist(), np.int64) for c in ("rep", "component", "block", "n_shingles"))
        pivot = np.array(table["is_pivot"].to_pylist(), bool)
        length, levels = folded(table["fine"].to_pylist())
        band, low, high = table["band"][0].as_py(), table["low"][0].as_py(), table["high"][0].as_py()
        earlier = np.array(table["earlier"].to_pylist(), np.int64) if band else None
        out_a, out_b = [], []
        for i in np.flatnonzero((block == low) & ~pivot):
            may = (block == high) & ~pivot & (comp != comp[i]) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i]))
            if low == high:
                may &= ids > ids[i]
            at = np.flatnonzero(may)
            if band and len(at):
                at = at[~(earlier[at] == earlier[i]).any(axis=1)]
            if len(at):
                differ = np.zeros(len(at), np.int64)
                shorter = np.minimum(length[at], length[i])
                for w in np.unique(shorter).tolist():
                    here = np.flatnonzero(shorter == w)
                    differ[here] = np.bitwise_count(levels[w][at[here]] ^ levels[w][i]).sum(axis=1, dtype=np.int64)
                at = at[differ * (100 + percent) <= (size[at] + size[i]) * (100 - percent)]
            out_a += [int(min(ids[i], ids[j])) for j in at]
            out_b += [int(max(ids[i], ids[j])) for j in at]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def find_near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """n_shingles, component_id and kept for every document, by links between whole texts.

    A document's set holds its distinct ``width``-word shingles, with A-Z in lower case (of
    fewer words: the whole sequence); documents link if 100 * intersection >= percent * union.
    component_id is the least id reachable over links, kept whether that is the document's
    own.  The sketch is sized for percent >= 80; lower values are refused.

    Ids are integers; others are refused.  The usual edge cases; documents without words
    link with nothing and are kept, as is a row with a null id, whose component is null.
    Each row of a repeated id gets the component that its own set reaches.
    """
    if percent < 80:
        raise ValueError("the banding is sized for a similarity of 0.8 or more")
    id_type = docs.schema[id_col].dataType
    found = components(docs, width, percent, id_col, text_col, Tables(docs.sparkSession))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").cast(id_type).alias(id_col), "n_shingles", F.col("component_id").cast(id_type).alias("component_id"), kept.alias("kept"))


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a hash of both, by which a text is found again."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("place"))


def components(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, tables: Tables) -> DataFrame:
    """id, place, n_shingles, component_id and whether it stays as the one row of its group, of every row; see find_near_duplicates."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    source = placed(docs, id_col, text_col)
    rows = tables.keep(sketched(source, width))
    usable = rows.where("rep is not null and id is not null")
    classes = tables.keep(usable.groupBy("rep").agg(F.min(F.struct("id", "place")).alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))

    # buckets with more than one member, and how many others each member meets
    entries = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    sizes = tables.keep(entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    least = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * CROWDED
    marked = entries.join(F.broadcast(sizes.where(F.col("n") > least)), ["band", "value"], "left")
    shared = tables.keep(marked.where("n is not null").unionByName(marked.where("n is null").drop("n").join(sizes.where(F.col("n") <= least), ["band", "value"])))
    tables.drop(sizes)
    meets = shared.groupBy("rep").agg(F.sum("n").alias("meets"))
    pivots = shared.join(meets, "rep").groupBy("band", "value", "n").agg(F.max(F.struct("meets", F.col("rep"))).alias("top")).select("band", "value", "n", F.col("top.rep").alias("pivot"))
    buckets = tables.keep(by_bucket(shared, pivots, least))
    tables.drop(shared)
    first_pairs = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()

    # full sets of one text of each class that shares a bucket
    wanted = tables.keep(buckets.select("rep").distinct().join(classes.select("rep", "least.place"), "rep").select("place"))
    sets = tables.keep(full_sets(sifted(source, wanted, "left_semi").join(wanted, "place", "left_semi").dropDuplicates(["place"]), width))
    tables.drop(wanted)
    shingles = sets.agg(F.coalesce(F.sum(F.length("members")), F.lit(0))).first()[0] // 8
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(shingles) // PART_SHINGLES))
    links = tables.keep(verified(first_pairs, sets, percent, n_parts))
    first = connected_components(links, tables)

    # what pivots left open, in blocks
    held = buckets.where("n > 2").join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_buckets = held.groupBy("band", "value", "n").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "value", "n")
    rest = tables.keep(by_bucket(held, open_buckets, least).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    tables.drop(buckets)
    still = sets.join(rest.select("rep").distinct(), "rep", "left_semi")
    traits = tables.keep(fine_sketches(still).join(classes.select("rep", "n_shingles", "bands"), "rep"))
    spread = rest.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.join(traits, "rep").select("band", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component", (F.col("rep") == F.col("pivot")).alias("is_pivot"), "n_shingles", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"), "fine")
    second_pairs = spread.groupBy("band", "value", "low", "high").applyInArrow(block_pairs(percent), "a long, b long")
    second_pairs = tables.keep(second_pairs)
    more = tables.keep(verified(second_pairs, sets, percent, n_parts))
    tables.drop(rest, traits, sets, second_pairs)
    joined = first if more.isEmpty() else connected_components(links.unionAll(more), tables)

    # back to documents: the first of all classes of a component
    labelled = classes.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").where("n > 1 or component is not null").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    first_of = labelled.groupBy("component").agg(F.min("least").alias("first"))
    reached = tables.keep(labelled.join(first_of, "component").select("rep", "first"))
    tables.drop(*{id(t): t for t in (links, more, first, joined, classes)}.values())
    first_id, first_place = F.col("first.id"), F.col("first.place")
    known = F.col("id").isNotNull()
    return rows.join(reached, "rep", "left").select(
        "id",
        "place",
        "n_shingles",
        F.when(known, F.coalesce(first_id, "id")).alias("component_id"),
        F.coalesce(~known | ((F.col("id") == first_id) & (F.col("place") == first_place)), F.lit(True)).alias("stays"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group of near duplicates: that of least id, of its rows that of least hash.

    The usual edge cases; rows without words and rows with a null id stay, and rows equal in
    id and text are one.  Ids are integers; extra columns pass through under any name.
    """
    tables = Tables(docs.sparkSession)
    found = components(docs, width, percent, id_col, text_col, tables)
    id_, place = F.col(id_col).cast("long"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    whole = docs.select(F.struct(*docs.columns).alias("all"), id_.alias("id"), place.alias("place"))
    if not found.where("id is not null").groupBy("id", "place").count().where("count > 1").isEmpty():
        whole = whole.where("id is not null").dropDuplicates(["id", "place"]).unionAll(whole.where("id is null"))
    gone = tables.keep(found.where(~F.col("stays")).select("id", "place").distinct())
    tables.drop_all_but(gone)
    left = sifted(whole, gone, "left_semi").join(gone, ["id", "place"], "left_anti").select("all")
    return sifted(whole, gone, "left_anti").select("all").unionAll(left).select("all.*")
