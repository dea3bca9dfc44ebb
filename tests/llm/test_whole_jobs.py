"""Parts of the job that operators once left out."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.llm import decontaminate, superkmers  # noqa: E402

NORMAL = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]


def similarity(text, item):
    """Of the best item-sized window; of the whole text where it is shorter than the item."""
    doc, own = NORMAL(text), NORMAL(item)
    k = min(5, len(own))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    theirs = grams(own)
    windows = [grams(doc[at : at + len(own)]) for at in range(max(1, len(doc) - len(own) + 1))]
    return max(sum((w & theirs).values()) / sum((w | theirs).values()) for w in windows)


def test_texts_shorter_than_an_item(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"t{rng.integers(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(size))) for i, size in enumerate([50, 50, 60, 25, 9, 5])]
    items.append((7, " ".join(["one two three"] * 20)))
    docs = []
    for i, text in items:
        words = text.split()
        for cut in range(0, 14):
            docs += [(len(docs), " ".join(words[cut:])), (len(docs) + 1, " ".join(words[: len(words) - cut]).upper())]
            docs.append((len(docs), " ".join(words[cut // 2 : len(words) - (cut - cut // 2)])))
    docs += [(len(docs), ""), (len(docs) + 1, "one"), (len(docs) + 2, " ".join(items[0][1].split()[:25] + ["other"] + items[0][1].split()[26:48]))]
    want = {(d, i): s for d, t in docs for i, x in items if (s := similarity(t, x)) >= 0.8}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(*frames).collect()}
    assert {k: r.similarity for k, r in got.items()} == want
    assert (4, 0) in want and got[4, 0].n_words == 49 and got[4, 0].first_word == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(*frames).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def windows_in(packed):
    return Counter(s for r in packed.collect() if r.strings for s in superkmers._unblob(r.strings))


def test_equal_windows_are_aggregated_before_they_meet(spark):
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(33)]
    docs = []
    for i in range(200):
        words = [f"v{x}" for x in rng.integers(0, 500, rng.integers(0, 60))]
        docs.append((i, words + passage + words[:3] if i % 2 else words))
    docs += [docs[7], docs[9]]
    all_hashes = superkmers.word_hashes([w.encode() for _, ws in docs for w in ws])
    hot = np.unique(superkmers.super_kmers(all_hashes, np.repeat(np.arange(len(docs)), [len(ws) for _, ws in docs]), 20)[2])
    df = spark.createDataFrame([(i, 0, " ".join(w)) for i, w in docs], "doc_id long, tie long, text string").repartition(6)
    packed = superkmers.pack(df, 20, 16, hot).cache()
    assert max(windows_in(packed).values()) <= 6  # one for each pack, not one for each text
    judged = superkmers.judge(packed, 20, 16).cache()
    met = judged.where("strings IS NOT NULL").selectExpr("bucket", "hot", "strings", "doc_ids AS doc_id", "ties AS tie", "start", "last")
    assert 1 < max(windows_in(met).values()) <= superkmers.SALTS
    runs = judged.where("strings IS NULL").collect() + superkmers.judge(met, 20).collect()
    got = {(r.doc_id, s) for r in runs for s in range(r.a, r.b + 1)}
    first, want = {}, set()
    for i, words in sorted(docs):
        for s in range(len(words) - 19):
            if first.setdefault(tuple(words[s : s + 20]), (i, s)) != (i, s):
                want.add((i, s))
    assert got == want and len(want) > 1000


def test_only_one_of_equal_texts_is_packed(spark, monkeypatch):
    long, short = " ".join(f"w{i}" for i in range(50)), "too short for a window"
    docs = [(i, [long, short, f"{long} {i} more"][i % 3]) for i in range(60)] + [(3, long), (3, short), (None, short)]
    seen, pack = [], superkmers.pack
    monkeypatch.setattr(superkmers, "pack", lambda once, *rest: seen.append(once.count()) or pack(once, *rest))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = superkmers.mark_repeats(df, 20).collect()
    assert seen == [22]  # doc 0, the null id, and 20 texts of their own
    assert len(rows) == len(docs)
    for r in rows:
        n = 50 if r.doc_id is not None and r.doc_id % 3 == 0 and r.n_words == 50 else 0
        if n or r.n_words == 5:
            assert r.n_removed == (n if r.doc_id else 0) and (r.kept == "" if n and r.doc_id else r.kept in (long, short))
        else:
            assert r.kept.split()[-2:] == [str(r.doc_id), "more"]


def test_tasks_hold_one_block_of_a_benchmark(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "and " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(12)], "doc_id long, text string")
    marked, name = decontaminate.add_matches(docs, items, block_items=2)
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, m.item_id) for r in marked.collect() for m in r[name]} == {(i, i) for i in range(9)}
