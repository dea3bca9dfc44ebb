"""Self-join of documents by the Jaccard similarity of their word shingles.

A MinHash LSH forest finds candidates: each of ``TREES`` trees has its own sequence of MinHash
values, and documents are candidates if they share a prefix of it. Prefixes are shortened from
the full depth until the chance that two documents of the wanted similarity share one in some
tree reaches the target recall. A join has one threshold for all texts, so that depth holds
for all of them; the texts of a prefix are grouped by its hash, and longer prefixes, whose
pairs are among those of the shorter ones, are not made. Candidates that hang together
then meet once, as whole texts, and are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components, with_group
from tidemark.llm.shared import free_name, gram_hashes, mixed, normal_words, pieces, shingle_set, spread_join, text_of, texts, word_hashes, written

SHINGLE = 5
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.9995
LEAST_DEPTH, MOST_TREES = 2, 512
#: Documents of a component that are compared in one task.
BLOCK = 1024
#: Documents of small components that share a group.
GROUP = 512


def forest(similarity: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> tuple[int, int]:
    """Trees and the longest prefix with which two texts of ``similarity`` meet with the target recall.

    Prefixes are shortened from the full depth. Where even ``LEAST_DEPTH`` values are too many,
    there are more trees, as a prefix of one value would bring nearly all texts together; an
    error where there would be more than ``MOST_TREES``.
    """
    def recall(trees: int, depth: int) -> float:
        return 1 - (1 - similarity**depth) ** trees

    while depth > LEAST_DEPTH and recall(trees, depth) < target:
        depth -= 1
    while recall(trees, depth) < target:
        trees += 1
        if trees > MOST_TREES:
            raise ValueError(f"a similarity of {similarity} needs more than {MOST_TREES} trees")
    return trees, depth


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``n`` hash functions, by rule."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n] | np.uint64(1), seeds[n:]


def trie_prefixes(documents: list[str], trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's prefix in each tree, and the texts' numbers of words."""
    words = [normal_words(d) for d in documents]
    counts = np.array([len(w) for w in words], np.int64)
    hashes = word_hashes([w for ws in words for w in ws])
    n = np.maximum(counts - SHINGLE + 1, 0)
    out = np.zeros((len(documents), trees), np.uint64)
    if len(hashes) >= SHINGLE and n.any():
        grams = gram_hashes(hashes, SHINGLE)
        first = np.cumsum(counts) - counts
        rows = np.flatnonzero(n > 0)
        ends = np.cumsum(n[rows])
        grams = grams[np.arange(ends[-1]) + np.repeat(first[rows] - ends + n[rows], n[rows])]
        a, b = coefficients(max(trees, TREES) * DEPTH)
        cuts = ends - n[rows]
        for t in range(trees):
            prefix = np.full(len(rows), t + 1, np.uint64)
            for d in range(depth):
                k = t * DEPTH + d
                least = np.minimum.reduceat((grams * a[k] + b[k]) >> np.uint64(16), cuts)
                prefix = mixed(prefix * np.uint64(31) + least)
            out[rows, t] = prefix
    for i in np.flatnonzero((counts > 0) & (n == 0)):  # shorter than a shingle: one shingle
        whole = gram_hashes(word_hashes(words[i]), int(counts[i]))[0]
        out[i] = mixed(whole + np.arange(trees, dtype=np.uint64))
    return out, counts


def _prefixes(source: DataFrame, trees: int, depth: int) -> DataFrame:
    def run(batches):
        for piece in pieces(batches):
            prefixes, counts = trie_prefixes(texts(piece.column(2)), trees, depth)
            lists = [p.view(np.int64).tolist() if c else [] for p, c in zip(prefixes, counts)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text_key", "prefixes"])

    return source.mapInArrow(run, "doc_id long, text_key binary, prefixes array<bigint>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    g = len(sets)
    out = np.zeros((g, g))
    if g == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    often = np.bincount(code, minlength=len(values))
    order = np.argsort(code, kind="stable")
    first = np.cumsum(often) - often
    for d in (2, 3):  # shingles of few documents: count the pairs
        at = first[often == d]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(out, (row[order[at + i]], row[order[at + j]]), 1)
    out += out.T
    dense = np.flatnonzero(often > 3)
    column = np.full(len(values), -1)
    column[dense] = np.arange(len(dense))
    use = column[code] >= 0
    use_row, use_column = row[use], column[code[use]]
    by = np.argsort(use_column, kind="stable")
    use_row, use_column = use_row[by], use_column[by]
    for lo in range(0, len(dense), 4096):  # others: products of 0/1 matrices
        a, b = np.searchsorted(use_column, [lo, lo + 4096])
        block = np.zeros((g, min(4096, len(dense) - lo)), np.float32)
        block[use_row[a:b], use_column[a:b] - lo] = 1
        out += block @ block.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets reach the threshold; never a set with itself."""
    sizes = np.array([len(s) for s in sets], float)
    both = overlaps(sets)
    np.fill_diagonal(both, 0)
    # The same in whole numbers, with room for the last bit of the threshold.
    return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def roots(links: np.ndarray) -> np.ndarray:
    """The least index of each row's component."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """text_key, root, n_links, cut for each member and block pair it is in."""
    schema = "text_key binary, root binary, n_links long, cut boolean"

    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        component = table.column("component").to_pylist()
        key = table.column("text_key").to_pylist()
        order = sorted(range(len(key)), key=lambda i: (component[i], key[i]))
        lo = 0
        while lo < len(order):
            hi = lo
            while hi < len(order) and component[order[hi]] == component[order[lo]]:
                hi += 1
            rows = [i for a, i in enumerate(order[lo:hi]) if not a or key[i] != key[order[lo + a - 1]]]  # a repeated row is one text
            picked = table.take(rows)
            side = np.array(picked.column("block").to_pylist())
            sets = [shingle_set(normal_words(t)) for t in texts(picked.column("text"))]
            links = linked(sets, threshold)
            cut = picked.column("blocks")[0].as_py() > 1
            if cut and picked.column("left")[0].as_py() != picked.column("right")[0].as_py():
                links &= side[:, None] != side[None, :]
            keys = [key[i] for i in rows]
            out[0] += keys
            out[1] += [keys[r] for r in roots(links)]
            out[2] += links.sum(axis=1).tolist()
            out[3] += [cut] * len(keys)
            lo = hi
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names=["text_key", "root", "n_links", "cut"])

    return members.groupBy("task").applyInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("text_key"), text_of(text_col).alias("text"))


def join_classes(docs: DataFrame, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text: text_key, rep (its least doc_id), copies, twins (rows
    of ``rep``), root (text_key of its class), n_links (other texts at or above the threshold).

    Exact copies are one text from the start, before anything is shuffled but keys. Shingles
    are runs of five lower-case words without ASCII punctuation; a shorter text is one
    shingle; a text without words links to nothing. Texts that hang together by shared
    prefixes are compared all with all: in one task if there are at most ``BLOCK``, else
    block by block in many, and classes are closed over the links of all blocks. Null texts
    are empty; a text whose doc_ids are all null has no rep; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    trees, use = forest(threshold, trees, depth, target_recall)
    keys = written(_prefixes(keyed, trees, use), "prefixes")
    copies = keys.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("prefixes").alias("prefixes"))
    twins = keys.groupBy("text_key", "doc_id").agg(F.count("*").alias("twins"))
    forms = written(
        copies.join(twins.withColumnRenamed("doc_id", "rep"), ["text_key", "rep"], "left").withColumn("twins", F.coalesce("twins", "copies")), "texts"
    )
    nodes = forms.select("text_key", F.explode("prefixes").alias("node"))
    met = with_group(nodes, "node", "text_key", least=(F.min("text_key"), F.min("least")))
    edges = met.select(F.col("text_key").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
    tree = components(edges, "candidates")
    component = tree.union(tree.select("b", "b")).distinct().toDF("text_key", "component")
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    placed = written(
        spread_join(component, sizes, ["component"], ["text_key"])
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
        .join(forms.select("text_key", "rep"), "text_key"),
        "members",
    )
    groups = max(1, placed.count() // GROUP)
    pairs = (
        placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", "left", "right")))
    )
    checked = written(_verify(_with_texts(pairs, keyed), threshold), "links")
    whole = checked.where(~F.col("cut")).select("text_key", "root", "n_links")
    parts = checked.where("cut")
    closed = components(parts.select(F.col("text_key").alias("a"), F.col("root").alias("b")), "classes")
    cut = (
        parts.groupBy("text_key").agg(F.sum("n_links").alias("n_links"))
        .join(closed.toDF("text_key", "root"), "text_key", "left")
        .select("text_key", F.coalesce("root", "text_key").alias("root"), "n_links")
    )
    return (
        forms.select("text_key", "rep", "copies", "twins")
        .join(whole.union(cut), "text_key", "left")
        .withColumn("root", F.coalesce("root", "text_key")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )


def _with_texts(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The text of one row of each member; repeated rows of it are dropped where they meet.

    Always a merge join: members are a share of the texts, so a broadcast has no bound.
    """
    right = keyed.toDF("their_id", "their_key", "text")
    return pairs.hint("merge").join(right, (F.col("text_key") == F.col("their_key")) & F.col("rep").eqNullSafe(F.col("their_id"))).select(
        "task", "component", "text_key", "block", "blocks", "left", "right", "text"
    )


def document_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links, n_copies: a row for each row.

    ``n_links`` counts other texts at or above the threshold, not their copies; ``n_copies``
    counts the rows with the same text, itself included. Rows with null ids have a class;
    a class without any id has a null class_id.
    """
    keyed = _keyed(docs, id_col, text_col).select("doc_id", "text_key")
    classes = written(join_classes(docs, threshold, id_col=id_col, text_col=text_col), "classes")
    named = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = spread_join(classes, named, ["root"], ["text_key"]).select("text_key", "class_id", "n_links", F.col("copies").alias("n_copies"))
    return spread_join(keyed, known, ["text_key"], ["doc_id"]).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least doc_id, in all its columns.

    Texts without words are a class as exact copies only. Of a class without any id, and of
    repeated rows, one row stays.
    """
    classes = written(join_classes(docs, threshold, id_col=id_col, text_col=text_col), "classes")
    first = classes.groupBy("root").agg(F.min_by(F.struct("text_key", "rep", "twins"), F.struct(F.col("rep").isNull(), "rep", "text_key")).alias("k")).select("k.*")
    key, doc, n = (free_name(docs, c) for c in ("stay_key", "stay_id", "stay_twins"))
    stay = first.toDF(key, doc, n)
    own_key = F.unhex(F.md5(text_of(text_col)))
    match = (own_key == F.col(key)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc))
    alone = docs.join(stay.where(F.col(n) == 1), match, "left_semi")
    many = docs.join(stay.where(F.col(n) > 1), match, "left_semi")
    return alone.union(many.withColumn(key, own_key).dropDuplicates([id_col, key]).drop(key))
