"""Substring deduplication by super-k-mers.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash
among its runs of ``MINIMISER_WORDS`` words, so equal windows have equal minimisers wherever
they stand. Consecutive windows with one minimiser travel as one packed string to the bucket
of that minimiser. In its bucket every distinct word gets a number, windows are sorted by a
hash of these numbers, and neighbours are compared number by number, so counts are exact.

Of equal texts only the one of the least document is packed. Windows of hot minimisers meet
in three steps: in their pack, in one of ``SALTS`` buckets by window and document, and in one
bucket by window. A window that is not the first of its equals in any step is repeated, and
only first ones go on, so at most ``SALTS`` of equal windows reach the last bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import gram_hashes, mixed, pieces, spread_join, text_of, texts, word_hashes, written

MINIMISER_WORDS = 3
#: Documents whose super-k-mers are packed together.
PACK_ROWS = 2000
#: Characters of text after which they are packed in any case.
PACK_CHARS = 8 << 20
#: Buckets for each shuffle partition, so that partitions even out.
BUCKETS = 8
#: A minimiser with more than this share of a sample's super-k-mers is spread by window.
HOT_SHARE = 1 / 2000
HOT_SAMPLE_ROWS = 4000
#: Buckets over which equal windows of a hot minimiser are spread before their firsts meet.
SALTS = 64
NULL_ID = -(1 << 63)
#: End of the one run of a text that a smaller document also has.
WHOLE = -1


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n``, by doubling."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(hashes: np.ndarray, of_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each super-k-mer of joined documents.

    ``hashes``: of all words; ``of_doc``: the document of each word, ascending.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    m = min(MINIMISER_WORDS, width)
    least = sliding_min(gram_hashes(hashes, m), width - m + 1)
    inside = of_doc[:n] == of_doc[width - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (of_doc[1:n] != of_doc[: n - 1])
    starts = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new | ~inside), n)
    lasts = ends[np.searchsorted(ends, starts, side="right")] - 1
    return starts, lasts, least[starts]


def _split(documents: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts; the document of each word; the first word of each document."""
    split = [d.encode().split() for d in documents]
    counts = np.array([len(s) for s in split], np.int64)
    return [w for s in split for w in s], np.repeat(np.arange(len(split)), counts), np.cumsum(counts) - counts


def hot_minimisers(docs: DataFrame, width: int, text_col: str = "text") -> np.ndarray:
    """Minimisers that are so frequent that their windows should be spread.

    From a sample of about ``HOT_SAMPLE_ROWS`` texts: it steers only to which bucket windows
    go, never which are compared. At most ``1 / HOT_SHARE`` are returned.
    """
    source = docs.select(text_of(text_col).alias("text"))
    some = source.sample(min(1.0, HOT_SAMPLE_ROWS / max(1, docs.count())), seed=7)

    def count(batches):
        for piece in pieces(batches):
            words, of_doc, _ = _split(texts(piece.column(0)))
            least = super_kmers(word_hashes(words), of_doc, width)[2]
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64))], names=["minimiser"])

    counted = some.mapInArrow(count, "minimiser long").rollup("minimiser").agg(F.count("*").alias("n"))
    rows = counted.orderBy(F.desc("n"), "minimiser").limit(int(1 / HOT_SHARE) + 1).collect()  # a bounded list
    total = sum(r["n"] for r in rows if r["minimiser"] is None)
    return np.array([r["minimiser"] for r in rows if r["minimiser"] is not None and r["n"] >= max(50, total * HOT_SHARE)], np.int64).view(np.uint64)


def _blob(strings: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(strings))


def _unblob(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


#: ``strings`` is null where ``start`` and ``last`` are runs that are known to be repeated.
PACKED = "bucket int, hot boolean, strings binary, doc_id binary, tie binary, start binary, last binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), *((n, pa.binary()) for n in ("strings", "doc_id", "tie", "start", "last"))])


def _longs(values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int64).tobytes())


def _unlongs(column) -> np.ndarray:
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64) for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _packed(bucket: int, hot: bool, strings: list[bytes] | None, doc, tie, start, last=None) -> pa.RecordBatch:
    row = [bucket, hot, None if strings is None else _blob(strings), _longs(doc), _longs(tie), _longs(start), None if last is None else _longs(last)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PACKED_ARROW)], schema=PACKED_ARROW)


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words; any number of bytes."""
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def salted(windows: np.ndarray, doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each window of a hot minimiser: one of ``SALTS``, by its document."""
    salt = mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(SALTS)
    return (mixed(windows ^ mixed(salt + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)


def runs_of(doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive places of one document."""
    cut = np.ones(len(place), bool)
    cut[1:] = (np.diff(place) != 1) | (np.diff(doc) != 0) | (np.diff(tie) != 0)
    at = np.flatnonzero(cut)
    return at, np.append(at[1:], len(place)) - 1


def pack(docs: DataFrame, width: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Super-k-mers by bucket; ``docs`` has doc_id, tie and text.

    The places travel beside the strings as packed arrays of 64-bit integers.
    """

    def run(batches):
        held, size = [], 0
        for piece in pieces(batches):
            held.append(piece)
            size += piece.nbytes
            if sum(p.num_rows for p in held) >= PACK_ROWS or size >= PACK_CHARS:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    def rows(held):
        documents = [t for p in held for t in texts(p.column(2))]
        ids = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in held])
        ties = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in held])
        words, of_doc, first_word = _split(documents)
        if len(words) < width:
            return
        hashes = word_hashes(words)
        starts, lasts, least = super_kmers(hashes, of_doc, width)
        bucket = (mixed(least) % np.uint64(buckets)).astype(np.int64)
        is_hot = np.zeros(len(starts), bool)
        if len(hot):
            spread = np.isin(least, hot)
            if spread.any():  # windows of their own, the first of equal ones of this pack
                n = lasts[spread] - starts[spread] + 1
                ends = np.cumsum(n)
                alone = np.arange(ends[-1]) + np.repeat(starts[spread] - ends + n, n)
                doc = of_doc[alone]
                alone = alone[np.lexsort((alone - first_word[doc], ties[doc], ids[doc]))]
                doc = of_doc[alone]
                place = alone - first_word[doc]
                f = repeated_windows(numbered(words), alone, width)
                later = np.flatnonzero((ids[doc[f]] != ids[doc]) | (ties[doc[f]] != ties[doc]) | (place[f] != place))
                if len(later):
                    d, t, p = ids[doc[later]], ties[doc[later]], place[later]
                    at, last = runs_of(d, t, p)
                    yield _packed(int(mixed(d[:1].view(np.uint64))[0] % np.uint64(buckets)), False, None, d[at], t[at], p[at], p[last])
                firsts = np.flatnonzero(f == np.arange(len(f)))
                alone, doc = alone[firsts], doc[firsts]
                whole = gram_hashes(hashes, width)[alone]
                starts, lasts = np.concatenate([starts[~spread], alone]), np.concatenate([lasts[~spread], alone])
                bucket = np.concatenate([bucket[~spread], salted(whole, ids[doc], buckets)])
                is_hot = np.arange(len(starts)) >= len(starts) - len(alone)
        if not len(starts):
            return
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        after = np.cumsum(lengths)  # one past the space behind each word
        begin, end = after - lengths, after - 1
        order = np.lexsort((starts, is_hot, bucket))
        starts, lasts, bucket, is_hot = starts[order], lasts[order], bucket[order], is_hot[order]
        a, b = begin[starts].tolist(), end[lasts + width - 1].tolist()
        doc = of_doc[starts]
        place = starts - first_word[doc]
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(is_hot) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            strings = [line[x:y] for x, y in zip(a[lo:hi], b[lo:hi])]
            yield _packed(int(bucket[lo]), bool(is_hot[lo]), strings, ids[doc[lo:hi]], ties[doc[lo:hi]], place[lo:hi])

    return docs.mapInArrow(run, PACKED)


def repeated_windows(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window, the index in ``starts`` of the first equal one.

    ``ids``: numbers of words; ``starts``: first words of windows, in the order that
    decides which of equal windows is first. Sorted by hash, then compared word by word.
    """
    hashes = gram_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), width)[starts]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), np.int64)
    first[order] = head
    other = np.flatnonzero(first != np.arange(len(first)))
    same = np.ones(len(other), bool)
    for k in range(width):
        same &= ids[starts[other] + k] == ids[starts[first[other]] + k]
    if not same.all():  # windows that share a hash by chance: compare them as they are
        odd = np.flatnonzero(np.isin(hashes, hashes[other[~same]]))
        rows = ids[starts[odd][:, None] + np.arange(width)]
        _, at, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        first[odd] = odd[at[inverse.reshape(-1)]]
    return first


JUDGED = "doc_id long, tie long, a long, b long, " + PACKED.replace("doc_id", "doc_ids").replace("tie", "ties")
JUDGED_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "tie", "a", "b")), *(pa.field({"doc_id": "doc_ids", "tie": "ties"}.get(f.name, f.name), f.type) for f in PACKED_ARROW)])


def _runs(doc, tie, a, b) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (doc, tie, a, b)] + [pa.nulls(len(doc), f.type) for f in PACKED_ARROW], schema=JUDGED_ARROW)


def _forward(bucket, strings, doc, tie, start) -> list[pa.Table]:
    """First windows by the bucket where all equal ones meet, in rows of up to ``PACK_ROWS``."""
    out, order = [], np.argsort(bucket, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
    for lo, hi in zip(edges, edges[1:]):
        for at in range(lo, hi, PACK_ROWS):
            some = order[at : min(hi, at + PACK_ROWS)]
            row = _packed(int(bucket[some[0]]), True, [strings[i] for i in some.tolist()], doc[some], tie[some], start[some])
            out.append(pa.Table.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), *row.columns], schema=JUDGED_ARROW))
    return out


def judge(packed: DataFrame, width: int, buckets: int = 0) -> DataFrame:
    """doc_id, tie and first and last start of runs of windows that also start earlier.

    With ``buckets``, also rows with ``strings``: the first windows of hot minimisers, packed
    by the bucket, of so many, where all equal ones meet.
    """

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("strings")))
        table = table.filter(pc.is_valid(table.column("strings")))
        out = [_runs(*(_unlongs(known.column(c)) for c in ("doc_id", "tie", "start", "last")))]
        if table.num_rows:
            out += compared(table)
        return pa.concat_tables(out)

    def compared(table: pa.Table) -> list[pa.Table]:
        blobs = [_unblob(blob) for blob in table.column("strings").to_pylist()]
        hot = np.repeat(table.column("hot").to_numpy(), [len(b) for b in blobs])
        strings = [s for blob in blobs for s in blob]
        del blobs
        doc, tie, start = (_unlongs(table.column(c)) for c in ("doc_id", "tie", "start"))
        order = np.lexsort((start, tie, doc))
        strings, doc, tie, start, hot = [strings[i] for i in order.tolist()], doc[order], tie[order], start[order], hot[order]
        counts = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
        line = b" ".join(strings)
        strings = [s if h else None for s, h in zip(strings, hot.tolist())]  # others are no longer needed
        ids = numbered(line.split())
        del line
        windows = counts - width + 1
        ends = np.cumsum(windows)
        of_string = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
        first = repeated_windows(ids, (np.cumsum(counts) - counts)[of_string] + offset, width)
        place = start[of_string] + offset
        f = of_string[first]
        earlier = (doc[f] != doc[of_string]) | (tie[f] != tie[of_string]) | (place[first] != place)
        out = []
        hit = np.flatnonzero(earlier)
        if len(hit):
            s = of_string[hit]
            a, b = runs_of(doc[s], tie[s], place[hit])
            out.append(_runs(doc[s[a]], tie[s[a]], place[hit[a]], place[hit[b]]))
        on = np.flatnonzero(hot[of_string] & (first == np.arange(len(first)))) if buckets else hit[:0]
        if len(on):  # windows of hot minimisers are strings of their own
            s = of_string[on]
            some = [strings[i] for i in s.tolist()]
            out += _forward((mixed(word_hashes(some)) % np.uint64(buckets)).astype(np.int64), some, doc[s], tie[s], place[on])
        return out

    return packed.groupBy("bucket").applyInArrow(run, JUDGED)


def later_copies(source: DataFrame) -> DataFrame:
    """doc_id and tie, once each, of texts that a smaller document also has."""
    ids = source.select("doc_id", "tie", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    least = ids.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    return spread_join(ids, least, ["digest"], ["doc_id"]).where("doc_id > least").select("doc_id", "tie")


def mark_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without repeated windows.

    Words are runs of characters that are not ASCII white space, unchanged. A word goes if a
    window that covers it also starts earlier: in a smaller doc_id (null before all), or
    earlier in the same document. Windows are judged on the input. Rows with the same doc_id
    and text are one document, each with its answer; different texts of one doc_id are
    ordered by a hash. ``kept`` joins the words left by one space. Null texts have no words;
    a text with fewer words than ``width`` has no window; an empty table gives no rows;
    other columns are not read.

    Texts that a smaller document also has are found by digest and not packed: all their
    windows also start there. Packed super-k-mers are shuffled by bucket, the first windows of
    minimisers that a sample shows to be hot once more, and texts twice by document: to leave
    out copies, and to meet the runs of their repeated windows.
    """
    spark = docs.sparkSession
    # One more sort key than the id: rows of one id with different texts.
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = hot_minimisers(source, width)
    copies = written(later_copies(source), "copies")
    # In one order, so that a task that runs again makes the same packs.
    once = source.join(copies, ["doc_id", "tie"], "left_anti").sortWithinPartitions("doc_id", "tie")
    judged = written(judge(pack(once, width, buckets, spread), width, buckets), "repeats")
    met = judged.where("strings IS NOT NULL").select("bucket", "hot", "strings", F.col("doc_ids").alias("doc_id"), F.col("ties").alias("tie"), "start", "last")
    run = ["doc_id", "tie", "a", "b"]
    runs = judged.where("strings IS NULL").select(run).unionByName(judge(met, width).select(run))
    whole = copies.select("doc_id", "tie", F.lit(0).cast("long").alias("a"), F.lit(WHOLE).cast("long").alias("b"))
    marks = runs.unionByName(whole).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = source.join(marks, ["doc_id", "tie"], "left").select("doc_id", "text", F.col("runs.a").alias("a"), F.col("runs.b").alias("b"))
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def keep(batches):
        for piece in pieces(batches):
            rows = []
            for doc, text, a, b in zip(*(piece.column(i).to_pylist() for i in range(4))):
                words = (text or "").encode().split()
                kept = words
                if a and b[0] == WHOLE:
                    kept = words if len(words) < width else []
                elif a:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, np.array(b) + width, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((None if doc == NULL_ID else doc, len(words), len(words) - len(kept), b" ".join(kept)))
            d, n, r, k = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(keep, schema)
