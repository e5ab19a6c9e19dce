"""Helpers shared by the document operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gridloom.shipping import ship

#: Bytes of text that one call of a text function gets at most, besides one whole text.
CHUNK_CHARS = 4_000_000
#: Characters of the longest word whose result a memo keeps.
MEMO_CHARS = 64
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Word separators of the document contracts: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: str.split() also parts words at these; texts that hold one take a slower way.
OTHER_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str) -> list[str]:
    """The maximal runs of characters outside SPACES."""
    for c in OTHER_SPACES[:4] if text.isascii() else OTHER_SPACES:
        if c in text:
            break
    else:
        return text.split()
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def prepare(spark: SparkSession) -> None:
    """Make the package importable for workers, and bound the rows of an Arrow batch where the session leaves Spark's default.

    Ten thousand long texts in one batch would fill a worker; a thousand are as fast.
    """
    ship(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


class Memo(dict):
    """Results by word.  Only short words are kept, and a full memo starts anew, so its bytes are bounded."""

    def __init__(self, make: Callable[[str], object], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        got = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


_held: list = []


def hold(cache) -> None:
    """Keep one operator's cache in this worker; all others forget."""
    for other in _held:
        if other is not cache:
            other.forget()
    _held[:] = [cache] if cache is not None else []


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, whose texts are of bounded length together, or one text."""
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, before + CHUNK_CHARS, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(total[end - 1])


def parts(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, as Python strings; a null text is empty."""
    for part in slices(batch, text_at):
        yield part, [t or "" for t in part.column(text_at).to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Apply a function of a list of texts; one output row per input row, id first.

    ``make`` runs once per task and returns the function; ``schema`` is the DDL of the
    columns that the function gives.  Columns of ``more`` pass through after the id.  What a
    function names as its ``cache`` stays for the next task of the same operator; it is told
    to ``forget`` when the worker goes on to another one.
    """
    kept = [id_col, *more]
    source = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(kept)), F.col(text_col).alias("text"))
    out = StructType.fromDDL(schema)
    full = StructType([*(StructField(c, source.schema[f"c{k}"].dataType) for k, c in enumerate(kept)), *out.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        hold(getattr(apply, "cache", None))
        for b in batches:
            for part, texts in parts(b, len(kept)):
                got = apply(texts)
                cols = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                cols += [pa.array(got[f.name], f.type) for f in list(arrow)[len(kept) :]]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    prepare(df.sparkSession)
    return source.mapInArrow(run, full)


def map_column(df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], column: str) -> DataFrame:
    """Replace one string column by a function of its values; all other columns pass through untouched.

    The usual edge cases; a null value goes to the function as the empty text.
    """
    arrow = to_arrow_schema(df.schema)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        hold(None)
        for b in batches:
            for part, texts in parts(b, at):
                new = pa.array(apply(texts), arrow.field(at).type)
                cols = [new if k == at else part.column(k).cast(arrow.field(k).type) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    prepare(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], column: str) -> DataFrame:
    """All columns of the rows whose text a function of a list of texts accepts; the usual edge cases."""
    arrow = to_arrow_schema(df.schema)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        hold(None)
        for b in batches:
            for part, texts in parts(b, at):
                kept = part.filter(pa.array(accept(texts), pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(k).cast(arrow.field(k).type) for k in range(kept.num_columns)], schema=arrow)

    prepare(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; only a local master may do without one, in tests."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None and not have.isEmpty():
        where = have.get()
    if where is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/gridloom-checkpoints"
    if have.isEmpty():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Write rows and cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate compressed tables in the shared folder.

    Each can be dropped after its last use; the others go when the session's file system
    closes, since a result that is not written yet may still read them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read back: lineage ends here."""
        path = f"{shared_folder(self.spark)}/gridloom-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, files, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, files, at = self.paths.pop(id(t))
            files.delete(at, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, *_ in [*self.paths.values()] if all(t is not k for k in tables)))


def stored(df: DataFrame) -> DataFrame:
    """One table that stays until the session's end."""
    return Tables(df.sparkSession).keep(df)
