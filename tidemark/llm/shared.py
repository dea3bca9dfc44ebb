"""Helpers that the text operators share: the shared folder, names, Arrow pieces, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that are turned into Python objects at once.
PIECE_ROWS = 256

#: Into how many parts the rows of one key are spread, so that a hot key is many tasks' work.
PARTS = 64

#: ASCII letters to lower case, other ASCII characters but digits to spaces.
WORD_BYTES = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder serves a local session; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read from there: lost executors cost no recomputation."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``key``.

    A share of the hashes that leaves about twice as many rows is cut out first, so that the
    sort for the least ones sees a bounded number of rows, however large the table is.
    """
    share = 2.0 * most / max(1, df.count())
    bits = 30
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1 << bits)) < int(share * (1 << bits))) if share < 1 else df
    return some.orderBy(F.xxhash64(key), key).limit(most)


def part_of(*columns: str) -> Column:
    """One of ``PARTS`` numbers, by the hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for each value of ``keys``.

    The rows of a key are spread over parts by the hash of ``by``. The parts that occur, at
    most ``PARTS`` of a key and never more than there are rows, fetch the columns first, and
    rows then meet their part. Null keys are equal to each other; rows without a partner go.
    """
    part = free_name(rows, "part")
    cut = rows.withColumn(part, part_of(*by))
    theirs = {k: f"{k}_of_key" for k in keys}
    occurring = cut.select(*[F.col(k).alias(theirs[k]) for k in keys], F.col(part).alias("part_of_key")).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & keyed[k].eqNullSafe(occurring[theirs[k]])
    fetched = occurring.join(keyed, match).drop(*keys)
    match = F.col(part) == F.col("part_of_key")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(theirs[k]))
    return cut.join(fetched, match).drop(part, "part_of_key", *theirs.values())


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front as long as a column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_of(column: str) -> Column:
    """The text; empty for null."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_pieces(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` bytes of that column's values, or one row.

    The column has strings, or lists of numbers.
    """
    for batch in batches:
        values = batch.column(column)
        if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
            lengths = pc.multiply(pc.list_value_length(values), values.type.value_type.bit_width // 8)
        else:
            lengths = pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def normal_words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return text.lower().encode().translate(WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    distinct = np.array([w.decode() for w in coded.dictionary.to_pylist()], dtype=object)
    hashes = pd.util.hash_array(distinct, categorize=False)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)]


#: Odd multipliers; a fixed rule, so that hashes agree everywhere.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` values; ``len - n + 1`` of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out * ODD[0]) ^ hashes[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all ``n``-word runs; a shorter text is one run; none if empty."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts in one row.

    A number for each word, the words that the numbers stand for, and the texts' numbers of
    words. Nulls are empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "") if column.null_count else column)
    words = lists.flatten()
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(some)])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = words.filter(pa.array(some)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.diff(np.concatenate([[0], before[ends]]))


class IdStore:
    """Token ids of many strings, each at a row of its own, in a few flat arrays."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.first, self.length, self.total = [np.zeros(0, np.uint32)], array("q"), array("q"), 0
        self.chars = 0

    def is_full(self, strings: int) -> bool:
        """Whether there are more strings than that, or as much text as they have usually."""
        return len(self) > strings or self.chars > 20 * strings

    def __len__(self) -> int:
        return len(self.first)

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.chars += sum(map(len, keys))
        self.rows.update(zip(keys, range(len(self.first), len(self.first) + len(lengths))))
        self.first.extend((self.total + np.cumsum(lengths) - lengths).tolist())
        self.length.extend(lengths.tolist())
        self.ids.append(ids)
        self.total += len(ids)

    def only(self, kept: np.ndarray) -> tuple[IdStore, np.ndarray]:
        """A store of the strings of those rows that are marked, and their rows here in its order."""
        rows = np.fromiter(self.rows.values(), np.int64, len(self.rows))
        some = kept[rows]
        ids, ends = self.gather(rows[some])
        store = IdStore()
        store.add(list(compress(self.rows, some.tolist())), ids, np.diff(ends, prepend=0))
        return store, rows[some]

    def missing(self, keys: Iterable[str]) -> list[str]:
        rows = self.rows
        return [k for k in keys if k not in rows]

    def rows_of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after another, and where each ends."""
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        first, n = np.frombuffer(self.first, np.int64)[rows], np.frombuffer(self.length, np.int64)[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[0][np.arange(total) + np.repeat(first - ends + n, n)], ends


def frame_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def in_slices(convert: Callable, rows: int = PIECE_ROWS) -> Callable:
    """A function for ``mapInArrow`` that converts slice after slice."""

    def run(batches):
        for batch in pieces(batches, rows):
            yield convert(batch)

    return run
