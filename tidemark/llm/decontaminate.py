"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as a benchmark item; a text that is shorter than an item, but long
enough to reach the threshold, is one window for it. Its features are the hashes of its five-word
shingles, weighted by how often they occur, and its fingerprint holds the signs of their
weighted sums over 64 bits. A shingle that no item has cannot count towards any item, and a
window shares none with an item unless it holds one of the item's, so fingerprints are made
only for windows with a shingle of some item they are made for. Fingerprints are cut into ``RADIUS + 1`` blocks: two that differ in at most
``RADIUS`` bits agree in a block, so looking up every block misses none within the radius.
Candidates are then checked by their exact weighted (multiset) Jaccard similarity.

At similarity 0.8 the cosine is at least 0.889 and two fingerprints differ in 9.7 of 64 bits
on average, with a deviation of 2.9; more than 18 differ in about 1 of 600 such windows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import WORD_BYTES, free_name, gram_hashes, normal_words, pieces, split_words, text_of, texts, word_hashes, written

SHINGLE = 5
BITS = 64
RADIUS = 18
#: Items that are sent to the tasks at once; larger benchmarks are scanned for in blocks.
BLOCK_ITEMS = 20_000

MATCHES = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle's hash."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit values with a bit for each positive sum."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def block_edges(radius: int = RADIUS) -> np.ndarray:
    return np.linspace(0, BITS, radius + 2).round().astype(int)


class Index:
    """A block of benchmark items, ready for looking up windows."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, radius: int = RADIUS):
        self.threshold, self.radius, self.edges = threshold, radius, block_edges(radius)
        groups: dict[int, list] = {}
        for item_id, text in items:
            words = normal_words(text or "")
            if words:
                groups.setdefault(len(words), []).append((item_id, gram_hashes(word_hashes(words), min(SHINGLE, len(words)))))
        self.groups = {n: self._group(rows) for n, rows in groups.items()}
        self.widths = sorted({min(SHINGLE, n) for n in self.groups})
        #: For each width: the shingles that some item has, a table of their last 20 bits, and
        #: the sizes of the items that have each.
        self.known = {}
        for w in self.widths:
            sizes: dict[int, set[int]] = {}
            for n, g in self.groups.items():
                if min(SHINGLE, n) == w:
                    for s in np.concatenate(g["shingles"]).tolist():
                        sizes.setdefault(s, set()).add(n)
            known = np.array(sorted(sizes), np.uint64)
            table = np.zeros(1 << 20, bool)
            table[_last_bits(known)] = True
            self.known[w] = known, table, [sorted(sizes[s]) for s in known.tolist()]

    def _group(self, rows):
        shingles = [s for _, s in rows]
        prints = fingerprints(np.array([bit_signs(s).sum(axis=0) for s in shingles]))
        tables = []
        for lo, hi in zip(self.edges, self.edges[1:]):
            part = self._part(prints, lo, hi)
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange((1 << (hi - lo)) + 1))
            tables.append((order, first))
        return {"ids": [i for i, _ in rows], "shingles": shingles, "prints": prints, "tables": tables, "counts": [Counter(s.tolist()) for s in shingles]}

    @staticmethod
    def _part(prints, lo, hi):
        return ((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def within_radius(self, group: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item of the group) that differ in at most ``radius`` bits."""
        found = []
        for (order, first), lo, hi in zip(group["tables"], self.edges, self.edges[1:]):
            part = self._part(prints, lo, hi)
            n = first[part + 1] - first[part]
            window = np.repeat(np.arange(len(prints)), n)
            item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)]
            near = np.bitwise_count(prints[window] ^ group["prints"][item]) <= self.radius
            found.append(window[near] * len(group["ids"]) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(group["ids"]), pairs % len(group["ids"])

    def search(self, documents: list[str]) -> list[list[dict]]:
        """For each text, the best window of each item that reaches the threshold, by item."""
        lines = pa.array([d.lower().encode().translate(WORD_BYTES) for d in documents], pa.binary()).cast(pa.string())
        number, distinct, counts = split_words(lines)
        hashes = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[number] if len(number) else np.zeros(0, np.uint64)
        first = np.cumsum(counts) - counts
        best: list[dict[int, tuple]] = [{} for _ in documents]
        for width in self.widths:
            shingles = gram_hashes(hashes, width)
            places, which = self._known(shingles, width)
            doc = np.searchsorted(first + counts, places, side="right")
            inside = places + width <= (first + counts)[doc]  # not across the end of a text
            places, which, doc = places[inside], which[inside], doc[inside]
            for i in np.unique(doc).tolist():
                own = doc == i
                self._search(shingles[first[i] : first[i] + counts[i] - width + 1], places[own] - first[i], which[own], width, best[i])
        return [[{"item_id": i, "similarity": s, "first_word": -a, "n_words": n} for i, (s, a, n) in sorted(b.items())] for b in best]

    def _known(self, shingles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that some item has, and which they are."""
        known, table, _ = self.known[width]
        maybe = np.flatnonzero(table[_last_bits(shingles)])
        there = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        same = known[there] == shingles[maybe]
        return maybe[same], there[same]

    def _search(self, shingles, places, which, width, best):
        """Windows of every size that some item with a shingle found here has."""
        by_size: dict[int, list[int]] = {}
        for place, w in zip(places.tolist(), which.tolist()):
            for n in self.known[width][2][w]:
                by_size.setdefault(n, []).append(place)
        for n, own in sorted(by_size.items()):
            m = n - width + 1  # shingles of a window
            if self.threshold * m <= len(shingles) < m:  # a text that is shorter than the item is its one window
                self._stretch(shingles, 0, len(shingles), m, width, self.groups[n], best)
            for lo, hi in _stretches(np.array(own), m, len(shingles)):  # first shingles of windows
                for at in range(lo, hi, 4096):
                    self._stretch(shingles[at : min(hi, at + 4096) + m - 1], at, m, m, width, self.groups[n], best)

    def _stretch(self, shingles, at, m, of_item, width, group, best):
        """Windows of ``m`` shingles against items of ``of_item``."""
        sums = np.zeros((len(shingles) + 1, BITS), np.int32)
        np.cumsum(bit_signs(shingles), axis=0, out=sums[1:])
        window, item = self.within_radius(group, fingerprints(sums[m:] - sums[:-m]))
        for w, i in zip(window.tolist(), item.tolist()):
            theirs = group["counts"][i]
            mine = Counter(shingles[w : w + m].tolist())
            both = sum(min(c, mine[s]) for s, c in theirs.items() if s in mine)
            similarity = both / (m + of_item - both)
            if similarity >= self.threshold:
                key = (similarity, -(at + w), m + width - 1)
                if key > best.get(group["ids"][i], (0,)):
                    best[group["ids"][i]] = key


def _last_bits(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64((1 << 20) - 1)).astype(np.int64)


def _stretches(places: np.ndarray, m: int, total: int) -> list[tuple[int, int]]:
    """Runs of first shingles whose windows of ``m`` shingles hold one of ``places``."""
    lo, hi = np.maximum(places - m + 1, 0), np.minimum(places + 1, total - m + 1)
    lo, hi = lo[lo < hi], hi[lo < hi]
    if not len(lo):
        return []
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist()))


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS):
    """The items in blocks of at most ``size``, the only rows that come to the driver at once."""
    rows = []
    for row in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((row[0], row[1]))
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def add_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, str]:
    """``docs`` with a column of benchmark matches, and the name of that column.

    Words are lower-case runs without ASCII punctuation; an item of fewer than five words is
    one shingle. A match names the item, the similarity of the most similar window (the
    earliest of ties) and where it stands. The scan goes row by row, once for each block of
    ``block_items`` items and written before the next, so that tasks hold one block's index
    and there is no shuffle and neither hot documents nor copies
    matter. Null and empty texts, and items without words, match nothing; repeated items and
    rows with null ids are matched each; an empty benchmark matches nothing. All columns of
    ``docs`` are kept; the new one gets underscores in front where its name is taken.
    """
    name = free_name(docs, "matches")
    out = docs.withColumn(name, F.expr(f"cast(array() as {MATCHES})"))
    place, text_at = len(docs.columns), docs.columns.index(text_col)
    index = None
    for items in item_blocks(benchmark, block_items):
        if index is not None:  # a block's scan ends before the next one's index is made
            out = written(out, "matches")
            index.unpersist()
        index = docs.sparkSession.sparkContext.broadcast(Index(items, threshold))  # of at most block_items items

        def run(batches, index=index):
            for piece in pieces(batches):
                found = [a + b for a, b in zip(piece.column(place).to_pylist(), index.value.search(texts(piece.column(text_at))))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:place], pa.array(found, piece.schema.field(place).type)], schema=piece.schema)

        out = out.mapInArrow(run, out.schema)
    return out, name


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: a row for each contaminated pair."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marked, name = add_matches(source, benchmark, threshold)
    return marked.select("doc_id", F.explode(name).alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """The documents without any match, in all their columns."""
    marked, name = add_matches(docs, benchmark, threshold, text_col)
    return marked.where(F.size(F.col(f"`{name}`")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
