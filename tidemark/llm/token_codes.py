"""Token ids as directly addressable codes.

An id is split into chunks of eight bits. Level 0 has the lowest chunk of every id, level 1
the second chunk of those ids that need one, and so on. A bitmap per level marks the ids
that continue, and a rank directory counts its ones before each block of 512 bits, so that
the id at any position is read by one look per level, without decoding its neighbours.

``write_tokens`` makes one row per segment of whole documents: Parquet is the envelope, so
that Spark's committer makes the files whole even if tasks are lost, and ``codes`` holds the
container described above. Rows are in ascending order of document id.
"""

from __future__ import annotations

import re
import string
import struct
import sys
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.shared import IdStore, frame_batch, pieces, sized_pieces, split_words, text_of, written

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
#: Distinct chunks of text that a worker remembers.
REMEMBERED = 800_000
#: Bytes of text that are encoded at once, or one text.
PIECE_BYTES = 1 << 23
#: Chunks whose ids are put together at once.
GATHERED = 1 << 16
#: Whether a chunk has small ASCII letters alone.
SMALL = re.compile("[a-z]+").fullmatch
#: What is cut off behind letters; not what may begin a special token or a short form.
MARKS = "".join(c for c in string.punctuation if c not in "<'")

SEGMENTS = "shard int, segment int, start long, n_tokens long, doc_id array<bigint>, offset array<bigint>, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """The container of a run of unsigned 32-bit ids."""
    left = np.asarray(ids, np.uint32)
    parts = []
    levels = 0
    while True:
        levels += 1
        more = left > 255
        parts.append(struct.pack("<Q", len(left)))
        parts.append((left & 255).astype(np.uint8).tobytes())
        padded = np.zeros(-(-len(left) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(left)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(axis=1)
        parts.append(np.packbits(padded, bitorder="little").tobytes())
        parts.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
        left = left[more] >> 8
        if not len(left):
            return MAGIC + struct.pack("<I", levels) + b"".join(parts)


class Codes:
    """Reads a container without unpacking it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a container of token codes")
        (levels,) = struct.unpack_from("<I", data, 4)
        at, self.levels = 8, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory, then the bytes of one block."""
        block, byte = at // RANK_BITS, at // 8
        whole = RANK_BITS // 8
        column = np.arange(whole)
        inside = bits[np.minimum(block[:, None] * whole + column, len(bits) - 1)]
        counts = np.bitwise_count(inside) * (column < (byte - block * whole)[:, None])
        last = bits[byte] & ((1 << (at % 8)) - 1).astype(np.uint8)
        return (ranks[block] + counts.sum(axis=1) + np.bitwise_count(last)).astype(np.int64)

    def at(self, positions) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("position outside of the container")
        out, here = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[here] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0
            here, at = here[more], self._rank(bits, ranks, at[more])
            if not len(here):
                break
        return out

    def run(self, start: int, end: int) -> np.ndarray:
        """The ids of ``start <= position < end``; on each level they are one run, too."""
        out, here = np.zeros(max(0, end - start), np.uint32), np.arange(max(0, end - start))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(here):
                break
            out[here] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            first = start - start % 8
            more = np.unpackbits(bits[first // 8 : -(-end // 8)], bitorder="little")[start - first : end - first].astype(bool)
            if not more.any():
                break
            start = int(self._rank(bits, ranks, np.array([start]))[0])
            here = here[more]
            end = start + len(here)
        return out


def strings(column: pa.Array) -> list[str]:
    """Much cheaper than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts by their chunks between ASCII white space, each distinct one once.

    For tokenizers whose tokens never cross white space and drop it, as ``word_bpe_49k``:
    its pattern has no white space, and neither composition nor lower-casing looks across.
    New chunks are encoded in long lines. A chunk of letters alone ends with the one token
    that is marked as the end of a word; behind any other stands a special token. Chunks of
    small ASCII letters are neither changed nor cut before the tokenizer's model sees them,
    so it gets them by themselves, if it agrees with the whole tokenizer on words of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        special = [(i, t.content) for i, t in sorted(added.items()) if t.special]
        self.mark_id, self.mark = special[0]
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # Letters that normalization turns into something with other characters.
        changing = (c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha())
        self.unstable = "[" + "".join(changing) + "]"
        own = sorted(w for w in (t.removesuffix(suffix or "") for t in vocabulary) if SMALL(w))[::20]
        self.plain = not any(SMALL(t.content.lower()) for t in added.values()) and all(
            self._ids(w).tolist() == [t.id for t in self.tokenizer.model.tokenize(w)] for w in map("".join, zip(own, own[::-1]))
        )
        self.cuts = all(self._ids(w + m).tolist() == self._ids(w).tolist() + self._ids(m).tolist() for w, m in zip(own, [*MARKS, MARKS, ".!!", "***"]))
        self.known = IdStore()
        self.uses = np.zeros(0, np.int32)  # in how many later pieces each was found, less at each cut

    def _make_room(self) -> None:
        """Forget what was not found again; of the rest, half of the room's most used are kept."""
        if not self.known.is_full(REMEMBERED):
            return
        order = np.argsort(-self.uses, kind="stable")[: min(REMEMBERED // 2, np.count_nonzero(self.uses))]
        kept = np.zeros(len(self.known), bool)
        kept[order] = True
        self.known, rows = self.known.only(kept)
        self.uses = self.uses[rows] // 2
        if self.known.is_full(REMEMBERED // 2):  # few, but long
            self.known, self.uses = IdStore(), np.zeros(0, np.int32)

    def _count(self, found: np.ndarray) -> None:
        """One more use of these rows, each given once."""
        self.uses = np.concatenate([self.uses, np.zeros(len(self.known) - len(self.uses), np.int32)])
        self.uses[found] += 1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks: list[str]) -> None:
        small, letters, others = [], [], []
        for c in chunks:
            (small if self.plain and SMALL(c) else letters if c.isalpha() else others).append(c)
        model = self.tokenizer.model
        for at in range(0, len(small), 200):
            some = small[at : at + 200]
            tokens = [model.tokenize(c) for c in some]
            self.known.add(some, np.array([t.id for ts in tokens for t in ts], np.uint32), np.array([len(ts) for ts in tokens]))
        for at in range(0, len(letters), 5000):
            some = letters[at : at + 5000]
            ids = self._ids("\n".join(some))
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                self.known.add(some, ids, np.diff(np.concatenate([[-1], ends])))
            else:  # a letter that is no letter in lower case
                others += some
        clean = [c for c in others if self.mark not in c]
        for at in range(0, len(clean), 2000):
            some = clean[at : at + 2000]
            ids = self._ids("".join(f"{c} {self.mark} " for c in some))
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(some):  # else a chunk became a mark in lower case: one by one, below
                self.known.add(some, ids[ids != self.mark_id], np.diff(np.concatenate([[-1], ends])) - 1)
        for c in self.known.missing(others):
            ids = self._ids(c)
            self.known.add([c], ids, np.array([len(ids)]))

    def _bases(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, list[str], np.ndarray]:
        """Each chunk as a base and the marks behind it, of which the first is none; see the class.

        Marks behind letters alone are a pre-token of their own, unless a letter leaves a mark
        when it is normalized. Where the tokenizer lowers letters, chunks of ASCII alone are
        lowered here, but not what may be a special token.
        """
        if self.lowers:
            plain = pc.and_not(pc.string_is_ascii(chunks), pc.match_substring(chunks, "<"))
            chunks = pc.if_else(plain, pc.ascii_lower(chunks), chunks)
        head = pc.ascii_rtrim(chunks, MARKS)
        marked = pc.and_(pc.less(pc.binary_length(head), pc.binary_length(chunks)), self.cuts)
        some = head.filter(marked)
        stable = pc.and_not(pc.utf8_is_alpha(some), pc.match_substring_regex(some, self.unstable))
        tails, tail = {" ": 0}, np.zeros(len(chunks), np.int64)
        pairs = zip(strings(chunks.filter(marked).filter(stable)), strings(some.filter(stable)))
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))[stable.to_numpy(zero_copy_only=False)]
        tail[at] = [tails.setdefault(c[len(h) :], len(tails)) for c, h in pairs]
        coded = pc.if_else(pa.array(tail > 0), head, chunks).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), list(tails), tail

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, ``end_id`` behind each text, and where texts end."""
        self._make_room()
        number, chunks, counts = split_words(column)
        bases, of_chunk, tails, tail = self._bases(chunks)
        bases = strings(bases)
        base_row = np.fromiter(map(self.known.rows.get, bases, repeat(-1)), np.int64, len(bases))
        new = np.flatnonzero(base_row < 0)
        self._count(base_row[base_row >= 0])
        unknown = [bases[i] for i in new.tolist()]
        self._learn(unknown)
        self._learn(self.known.missing(tails[1:]))
        base_row[new] = self.known.rows_of(unknown)
        end = f" {end_id}"  # no chunk has a space
        if self.known.missing([end, " "]):
            self.known.add([end, " "], np.array([end_id], np.uint32), np.array([1, 0]))
        # The chunks of these texts, from base and marks; the end is one more.
        rows = np.empty(2 * len(of_chunk) + 2, np.int64)
        rows[:-2:2], rows[1:-2:2] = base_row[of_chunk], self.known.rows_of(tails)[tail]
        rows[-2:] = self.known.rows[end], self.known.rows[" "]
        ids, ends = self.known.gather(rows)
        last = ends[1::2]
        first = np.concatenate([[0], last[:-1]])
        words = np.cumsum(counts)
        number = np.insert(number, words, len(of_chunk))
        upto = np.cumsum((last - first)[number])
        out = np.empty(upto[-1], np.uint32)
        for at in range(0, len(number), GATHERED):
            some = number[at : at + GATHERED]
            n = (last - first)[some]
            own = np.cumsum(n)
            out[upto[at] - n[0] :][: own[-1]] = ids[np.arange(own[-1]) + np.repeat(first[some] - own + n, n)]
        return out, upto[words + np.arange(len(counts))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of every whole text in ascending order of document id.

    One sort by range, in which equal ids are ordered by a hash of their text so that one id
    may have any number of rows; then each task writes its range. A null text is empty and
    has the end id only; null ids come first; repeated rows are written each; an empty table
    gives no rows. Other columns are not read. A segment closes after the document with
    which it reaches ``segment_tokens``; a longer document is a segment of its own.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    # Only ids and hashes are sampled for the ranges and sorted as keys.
    ordered = source.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = spark.createDataFrame([], SEGMENTS).schema

    def encode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0

        def row():
            lengths = np.array([len(x) for x in held], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            return frame_batch(arrow, [[shard], [segment], [start], [int(offsets[-1])], [names], [offsets.tolist()], [pack(np.concatenate(held))]])

        for piece in sized_pieces(batches, 1, PIECE_BYTES):
            ids, ends = encoder(tokenizer).encode(piece.column(1), end_id)
            before = 0
            for name, upto in zip(piece.column(0).to_pylist(), ends.tolist()):
                held.append(ids[before:upto])
                before = upto
                names.append(name)
                size += len(held[-1])
                if size >= segment_tokens:
                    yield row()
                    segment, start = segment + 1, start + size
                    held, names, size = [], [], 0
        if held:
            yield row()

    ordered.select("doc_id", "text").mapInArrow(encode, schema).write.parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments, ``start`` counted over all files.

    The totals of the shards, one row per writing task, are the only thing that is joined
    by broadcast; the codes are not moved.
    """
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    totals = {r[0]: r[1] for r in segments.groupBy("shard").agg(F.sum("n_tokens")).collect()}  # one row per writing task
    rows, before = [], 0
    for shard in sorted(totals):
        rows.append((shard, before))
        before += totals[shard]
    starts = spark.createDataFrame(rows, "shard int, before long")
    return segments.join(F.broadcast(starts), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in all files), tokens (array of its ids)."""
    schema = spark.createDataFrame([], "doc_id long, start long, tokens array<bigint>").schema

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for name, offsets, codes, start in _segments(batches):
            for i, doc in enumerate(name):
                ids = codes.run(offsets[i], offsets[i + 1])
                yield frame_batch(arrow, [[doc], [start + offsets[i]], pa.array([ids.astype(np.int64)], pa.list_(pa.int64())).cast(arrow.field(2).type)])

    return read_segments(spark, folder).mapInArrow(decode, schema)


def _segments(batches):
    for piece in pieces(batches, 1):
        row = piece.to_pylist()[0]
        yield row["doc_id"], row["offset"], Codes(row["codes"]), row["start"]


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    schema = spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long").schema

    def digest(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for name, offsets, codes, start in _segments(batches):
            data = memoryview(codes.run(0, len(codes)).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield frame_batch(arrow, [name, [start + a for a in offsets[:-1]], [b - a for a, b in zip(offsets, offsets[1:])], crc])

    return read_segments(spark, folder).mapInArrow(digest, schema)


#: Wanted positions that are sent to all tasks; more of them meet their segments by a shuffle.
MOST_SENT = 200_000

#: Segments that are named to the scan, which then skips the row groups of others.
MOST_NAMED = 1_000


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Random access: ``wanted`` has doc_id and position; returns doc_id, position, token.

    Positions first find their segments in the directory, which has no codes. At most
    ``most_sent`` of them go to the tasks that read the containers, so no container is shuffled,
    and few segments are named to the scan; more are joined with their segments. Of a container
    that is read, only the bits of the wanted tokens are looked at. Positions outside of a
    document give no row; repeated ones give one.
    """
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    directory = segments.select("shard", "segment", F.posexplode("doc_id").alias("at", "doc_id"), "offset").select(
        "shard", "segment", "doc_id", F.element_at("offset", F.col("at") + 1).alias("a"), F.element_at("offset", F.col("at") + 2).alias("b")
    )
    found = written(
        directory.join(wanted.select("doc_id", "position").distinct(), "doc_id")
        .where((F.col("position") >= 0) & (F.col("position") < F.col("b") - F.col("a")))
        .select("shard", "segment", "doc_id", "position", (F.col("a") + F.col("position")).alias("at")),
        "wanted",
    )
    each = found.groupBy("shard", "segment").agg(F.collect_list(F.struct("doc_id", "position", "at")).alias("wanted"))
    codes = segments.select("shard", "segment", "codes")
    if found.count() <= most_sent:
        named = found.select("shard", "segment").distinct().limit(MOST_NAMED + 1).collect()
        if len(named) <= MOST_NAMED:
            codes = codes.where(F.col("shard").isin([r.shard for r in named]) & F.col("segment").isin([r.segment for r in named]))
        each = F.broadcast(each)
    schema = spark.createDataFrame([], "doc_id long, position long, token long").schema

    def look(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for piece in pieces(batches, 1):
            row = piece.to_pylist()[0]
            doc, position, at = ([w[n] for w in row["wanted"]] for n in ("doc_id", "position", "at"))
            tokens = Codes(row["codes"]).at(np.array(at, np.int64))
            yield frame_batch(arrow, [doc, position, tokens.astype(np.int64)])

    return codes.join(each, ["shard", "segment"]).select("codes", "wanted").mapInArrow(look, schema)
