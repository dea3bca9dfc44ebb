"""Byte-level BPE by merge ranks, with a hierarchical-bitmap rank queue.

Each possible merge rank has a bucket of positions in a linked list of the pre-token's
parts. Two levels of bitmaps say which buckets hold something, so the lowest rank is found by
two find-first-set steps. A merge does not search for entries that it makes
obsolete: they are recognised and skipped when they come up. Pre-tokens of n bytes take
O(n log n) however long they are.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from itertools import chain, repeat
from operator import is_not

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import IdStore, sized_pieces, text_of

#: Distinct pre-tokens, and pieces made of several, that a worker remembers.
REMEMBERED = 250_000

#: Bytes of texts, or of their ids, that are turned into Python objects at once; a larger row is alone.
PIECE_BYTES = 1 << 20

#: Bytes of pre-tokens that share a queue; a longer one has a queue of its own. Large buckets need many.
BUFFER_BYTES = 1 << 18

#: From this many entries on, a bucket is merged as arrays.
BULK = 80

#: Mark of a place where no part starts, since a merge has taken it in.
INSIDE = -2

#: Ranks under one bit of the upper bitmap.
WORD_BITS = 256


class Merger:
    """Splits byte strings into the tokens of a rank table.

    The strings stand one behind another in one buffer and share a queue: ``low``, a bitmap
    word for each ``WORD_BITS`` ranks, ``top``, a bitmap of the words that aren't empty, and
    ``buckets`` with the positions of each rank in the queue. The lowest rank is taken with all
    of its positions, which are merged from left to right: those of a large bucket at once, as
    arrays. If a merge makes a pair of a lower rank, the rest of its string goes back, since that
    pair is next there; strings do not touch each other, so the order among them does not
    matter. The queue is empty between calls.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        most = max(ranks.values()) + 1
        self.low = [0] * ((most - 1) // WORD_BITS + 1)
        self.buckets: list[list[int] | None] = [None] * most
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        fronts, backs, made = array("i"), array("i"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                front = ranks.get(token[:cut])
                if front is not None:
                    back = ranks.get(token[cut:])
                    if back is not None:
                        fronts.append(front)
                        backs.append(back)
                        made.append(rank)
        self.right, self.left = Partners(fronts, backs, made, most), Partners(backs, fronts, made, most)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.encode_all([piece])[0].tolist()

    def encode_all(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all strings, one behind another, and their number in each."""
        ids, counts, at = [], [], 0
        while at < len(strings):
            upto, size = at, 0
            while upto < len(strings) and (upto == at or size + len(strings[upto]) <= BUFFER_BYTES):
                size += len(strings[upto])
                upto += 1
            some, n = self._merge(strings[at:upto])
            ids.append(some)
            counts.append(n)
            at = upto
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _merge(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buffer = b"".join(strings)
        n = len(buffer)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(strings), np.int64)
        parts = Parts(buffer, np.cumsum(sizes), self)
        buckets, low, top = self.buckets, self.low, self._put(0, *parts.first_pairs(self.pair))
        while top:
            word = (top & -top).bit_length() - 1  # find first set, twice
            bits = low[word]
            bit = bits & -bits
            now = (word << 8) + bit.bit_length() - 1
            bucket, buckets[now] = buckets[now], None
            low[word] = bits = bits ^ bit
            if not bits:
                top &= top - 1
            if len(bucket) >= BULK:
                bucket, *pairs = self._merge_bulk(parts, now, np.array(bucket, np.int32))
                top = self._put(top, *pairs)
            else:
                bucket.sort()
            if bucket:
                top = self._merge_each(parts, now, bucket, top)
        kept = parts.pending[:n] != INSIDE
        upto = np.concatenate([[0], np.cumsum(kept)])
        return parts.token[:n][kept].astype(np.int64), upto[parts.ends] - upto[parts.ends - sizes]

    def _put(self, top: int, places: np.ndarray, ranks: np.ndarray) -> int:
        """Put pairs into the queue; the upper bitmap."""
        if not len(ranks):
            return top
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order].tolist(), ranks[order]
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        buckets, low, bounds = self.buckets, self.low, [*first.tolist(), len(places)]
        for k, rank in enumerate(ranks[first].tolist()):
            some, bucket = places[bounds[k] : bounds[k + 1]], buckets[rank]
            if bucket is None:
                buckets[rank] = some
                low[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
            else:
                bucket += some
        return top

    def _merge_bulk(self, parts: Parts, now: int, place: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Merge a bucket's pairs at once, and give the new pairs' places and ranks.

        First come the places in strings where a merge, also one amid the others, makes a pair that is
        not above ``now`` and so is next: nothing has been done there.
        """
        pending, token, after, before, edge = parts.pending, parts.token, parts.after, parts.before, parts.edge
        place.sort()
        some = pending[place] == now
        some[1:] &= place[1:] != place[:-1]
        every = place = place[some]
        inner = after[place]
        chained = inner[:-1] == place[1:]
        if chained.any():  # of equal tokens in a row, every other one begins a pair
            number = np.arange(len(place))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), number, 0))
            some = (number - start) % 2 == 0
            place, inner = place[some], inner[some]
        end, left = after[inner], before[place]
        closed = edge[end]
        amid = right = self.right.rank_of(now, token[end])  # amid the others, and after all
        amid[closed] = -1
        open_left = ~edge[place]
        beside = end[:-1] == place[1:]  # the next pair touches this one
        beside &= ~closed[:-1]
        if beside.any():
            right = amid.copy()
            right[:-1][beside] = self.right.rank_of(now, np.array([now], np.int32))[0]
            open_left[1:] &= ~beside
        before_it = self.left.rank_of(now, token[left])
        before_it[~open_left] = -1
        early = np.minimum(amid.view(np.uint32), np.minimum(right.view(np.uint32), before_it.view(np.uint32))) <= now
        apart = []
        if early.any():
            string = np.searchsorted(parts.ends, place, "right")
            some = ~np.isin(string, string[early])
            apart = every[np.isin(np.searchsorted(parts.ends, every, "right"), string[early])].tolist()
            place, inner, end, left, right, before_it, open_left = (x[some] for x in (place, inner, end, left, right, before_it, open_left))
        token[place], after[place], pending[inner], pending[place], before[end] = now, end, INSIDE, right, place
        left, before_it = left[open_left], before_it[open_left]
        new = (before_it >= 0) & (pending[left] != before_it)
        pending[left] = before_it
        some = right >= 0
        return apart, np.concatenate([place[some], left[new]]), np.concatenate([right[some], before_it[new]])

    def _merge_each(self, parts: Parts, now: int, bucket: list[int], top: int) -> int:
        """Merge a sorted bucket's pairs one by one, and put the new pairs into the queue; the upper bitmap.

        If a merge makes a pair that is next in its string, the rest of that string goes back.
        """
        pending, token, after, before, edges = parts.flat
        buffer, get, buckets, low = parts.buffer, self.ranks.get, self.buckets, self.low
        back, at = [], 0
        while at < len(bucket):
            lowest = now + 1
            for at in range(at, len(bucket)):
                i = bucket[at]
                if pending[i] != now:
                    continue
                j = after[i]
                after[i] = end = after[j]
                token[i] = now
                pending[j] = INSIDE
                if edges[end]:
                    pending[i] = -1
                else:
                    before[end] = i
                    rank = get(buffer[i : after[end]])
                    if rank is None:
                        pending[i] = -1
                    else:
                        pending[i] = rank
                        if rank < lowest:
                            lowest = rank
                        other = buckets[rank]
                        if other is None:
                            buckets[rank] = [i]
                            low[rank >> 8] |= 1 << (rank & 255)
                            top |= 1 << (rank >> 8)
                        else:
                            other.append(i)
                if not edges[i]:
                    i = before[i]
                    rank = get(buffer[i:end])
                    if rank is None:
                        pending[i] = -1
                    elif pending[i] != rank:
                        pending[i] = rank
                        if rank < lowest:
                            lowest = rank
                        other = buckets[rank]
                        if other is None:
                            buckets[rank] = [i]
                            low[rank >> 8] |= 1 << (rank & 255)
                            top |= 1 << (rank >> 8)
                        else:
                            other.append(i)
                if lowest <= now:
                    break
            at += 1
            if lowest <= now:
                upto = bisect_left(bucket, int(parts.ends[np.searchsorted(parts.ends, i, "right")]), at)
                back += bucket[at:upto]
                at = upto
        return self._put(top, np.array(back, np.int32), np.full(len(back), now)) if back else top


class Parts:
    """The parts of strings that stand one behind another: a linked list on flat arrays.

    ``pending`` has the rank of the pair that starts at a place, -1 for none and ``INSIDE`` where no part
    starts; entries of the queue with other ranks are stale. ``flat`` has the same memory for single places.
    """

    def __init__(self, buffer: bytes, ends: np.ndarray, merger: Merger):
        n = len(buffer)
        self.buffer, self.ends = buffer, ends
        self.edge = np.zeros(n + 1, bool)  # no pair goes across
        self.edge[0] = True
        self.edge[ends] = True
        self.numbers = np.frombuffer(buffer, np.uint8).astype(np.int32)
        flat = [array("i", bytes(4 * (n + 1))) for _ in range(4)]
        self.pending, self.token, self.after, self.before = (np.frombuffer(x, np.int32) for x in flat)
        self.flat = (*flat, self.edge.tobytes())
        self.pending[:] = -1
        self.token[:n] = merger.single[self.numbers]
        self.after[:] = np.arange(1, n + 2)
        self.before[:] = np.arange(-1, n)

    def first_pairs(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ranks of the pairs of bytes."""
        n = len(self.buffer)
        self.pending[: n - 1] = np.where(self.edge[1:n], -1, pair[self.numbers[:-1] * 256 + self.numbers[1:]])
        place = np.flatnonzero(self.pending >= 0)
        return place, self.pending[place]


class Partners:
    """For each token the tokens that make a token with it, on one side, and that token's rank."""

    def __init__(self, mine: array, other: array, made: array, tokens: int):
        mine, other, made = (np.array(x, np.int32) for x in (mine, other, made))
        order = np.lexsort((other, mine))
        self.other, self.made = other[order], made[order]
        self.bounds = np.searchsorted(mine[order], np.arange(tokens + 1)).tolist()

    def rank_of(self, token: int, others: np.ndarray) -> np.ndarray:
        """-1 for those that make none."""
        first, upto = self.bounds[token], self.bounds[token + 1]
        if first == upto:
            return np.full(len(others), -1, np.int32)
        known = self.other[first:upto]
        at = np.minimum(np.searchsorted(known, others), upto - first - 1)
        made = self.made[first:upto][at]
        made[known[at] != others] = -1
        return made


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes texts by their pieces between single spaces, each distinct one once.

    A space between two characters that are not white space starts a match of the pattern,
    and no match goes across it, so a piece with the space in front of it can be matched by
    itself. A text with other white space around a space is matched as a whole. New pieces
    are matched one behind another, with their spaces.
    """

    def __init__(self, path: str, pattern: str):
        self.merger, self.pattern = Merger(read_ranks(path)), regex.compile(pattern)
        self.known = IdStore()  # pre-tokens, and pieces of several
        self.uses = np.zeros(0, np.int32)  # in how many later batches each was found, less at each cut

    def _make_room(self) -> None:
        """Forget what was not found again; of the rest, half of the room's most used are kept."""
        if not self.known.is_full(REMEMBERED):
            return
        self._count(np.zeros(0, np.int64))
        order = np.argsort(-self.uses, kind="stable")[: min(REMEMBERED // 2, np.count_nonzero(self.uses))]
        kept = np.zeros(len(self.uses), bool)
        kept[order] = True
        self.known, rows = self.known.only(kept)
        self.uses = self.uses[rows] // 2
        if self.known.is_full(REMEMBERED // 2):  # few, but long
            self.known, self.uses = IdStore(), np.zeros(0, np.int32)

    def _count(self, rows: np.ndarray) -> None:
        self.uses = np.concatenate([self.uses, np.zeros(len(self.known) - len(self.uses), np.int32)])
        self.uses[rows] += 1

    def _learn(self, pieces_: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of new pieces, known afterwards, then the ids of the texts and how many each has."""
        tokens = self.pattern.findall("".join(pieces_))
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces_), np.int64, len(pieces_))), "right")
        counts, mine = np.diff(upto, prepend=0), len(tokens)
        split = [self.pattern.findall(t) for t in texts]
        tokens.extend(chain.from_iterable(split))
        before = len(self.known)
        new = list(dict.fromkeys(self.known.missing(tokens)))
        if new:
            get = self.merger.ranks.get
            coded = [t.encode() for t in new]
            whole = [get(c) for c in coded]
            split_up = [k for k, rank in enumerate(whole) if rank is None]
            kept = [k for k, rank in enumerate(whole) if rank is not None]
            self.known.add([new[k] for k in kept], np.array([whole[k] for k in kept], np.uint32), np.ones(len(kept), np.int64))
            ids, lengths = self.merger.encode_all([coded[k] for k in split_up])
            self.known.add([new[k] for k in split_up], ids.astype(np.uint32), lengths)
        rows = self.known.rows_of(tokens)
        self._count(rows[rows < before])
        ids, n = self._joined(rows[mine:], np.fromiter(map(len, split), np.int64, len(split)))
        piece_rows = rows[upto - counts]
        several = np.flatnonzero(counts > 1)
        if len(several):
            piece_rows[several] = len(self.known) + np.arange(len(several))
            self.known.add([pieces_[i] for i in several.tolist()], *self._joined(rows[:mine][np.repeat(counts > 1, counts)], counts[several]))
        return piece_rows, ids, n

    def _joined(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows, one after another, and how many each run of them has."""
        ids, ends = self.known.gather(rows)
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and where each text ends."""
        column = pc.fill_null(column, "")
        lists = pc.split_pattern(column, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        number, pieces_ = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.fromiter(map(is_not, map(str.strip, pieces_), pieces_), bool, len(pieces_))  # strip gives itself if it strips nothing
        odd |= pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0
        doc = np.repeat(np.arange(len(counts)), counts)
        whole = np.zeros(len(counts), bool)
        whole[doc[odd[number]]] = True
        # A piece of a text, the first piece of a text, or a whole text.
        first = np.cumsum(counts) - counts
        starts = [column[i].as_py() if w else pieces_[k] for i, (w, k) in enumerate(zip(whole.tolist(), number[first].tolist()))]
        use = ~whole[doc]
        use[first[counts > 0]] = False
        occurs = np.zeros(len(pieces_), bool)
        occurs[number[use]] = True
        used = np.flatnonzero(occurs)
        self._make_room()
        units = [" " + pieces_[i] for i in used.tolist()]
        unit_row = np.fromiter(map(self.known.rows.get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(unit_row < 0)
        self._count(unit_row[unit_row >= 0])
        unit_row[unknown], ids, n = self._learn([units[i] for i in unknown.tolist()], starts)
        row = np.zeros(len(pieces_), np.int64)
        row[used] = unit_row
        base = len(self.known)
        joined = IdStore()  # what is known and the starts, for one gather
        joined.ids = [*self.known.ids, ids]
        joined.first = array("q", self.known.first)
        joined.first.extend((self.known.total + np.cumsum(n) - n).tolist())
        joined.length = array("q", self.known.length)
        joined.length.extend(n.tolist())
        order = np.where(use, row[number], -1)
        order[first] = base + np.arange(len(counts))
        kept = use.copy()
        kept[first] = True
        out, ends = joined.gather(order[kept])
        return out, ends[np.cumsum(np.bincount(doc[kept], minlength=len(counts))) - 1] if len(ends) else np.zeros(0, np.int64)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the tokens of every whole text, in place, without a shuffle.

    Each match of ``pattern`` is merged separately. A null or empty text has no ids; repeated
    rows and rows with null ids are encoded each; other columns are not read. A worker holds
    a few texts and a bounded memory of pre-tokens.
    """
    key, schema = (ranks, pattern), "doc_id long, ids array<int>"

    def run(batches):
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        for piece in sized_pieces(batches, 1, PIECE_BYTES):
            ids, ends = _ENCODERS[key].encode(piece.column(1))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, schema)


_TABLES: dict[str, pa.Array] = {}


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for. Null ids decode to nothing."""
    schema = "doc_id long, ids array<int>, decoded binary"

    def run(batches):
        if ranks not in _TABLES:
            table = read_ranks(ranks)
            tokens = [b""] * (max(table.values()) + 1)
            for token, rank in table.items():
                tokens[rank] = token
            _TABLES[ranks] = pa.array(tokens, pa.binary())
        for piece in sized_pieces(batches, 1, PIECE_BYTES):
            lists = piece.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, _TABLES[ranks].take(lists.flatten())), b"")
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
