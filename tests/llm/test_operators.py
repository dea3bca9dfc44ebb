"""Each operator against brute force, and on awkward tables."""

import base64
import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest import LONG, TEXTS  # noqa: E402

from tidemark.llm import byte_bpe, chat, components, decontaminate, jaccard_join, licenses, pii, quality_rules, rule_ensemble, superkmers, token_codes
from tidemark.llm.shared import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SOME = [t or "" for _, t in TEXTS]


# Token codes


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.randoms())
@settings(max_examples=40, deadline=None)
def test_codes_give_any_position(ids, random):
    codes = token_codes.Codes(token_codes.pack(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    if ids:
        at = [random.randrange(len(ids)) for _ in range(20)]
        assert codes.at(at).tolist() == [ids[i] for i in at]
        a, b = sorted([random.randrange(len(ids)), random.randrange(len(ids))])
        assert codes.run(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        codes.at([len(ids)])


@pytest.mark.parametrize("extra", [[], ["<|startoftext|>", "a<|endoftext|>b", "<|STARTOFTEXT|> İstanbul. İ, ǅ", "don't we'll. 3.5,6", "\u0338a >\u0338b", "J\u030c, \u0958. \u0130, H\u0331. A\u030a."],
    ["end.!! end*** END,### über&&& don't'. 'tis' dogs' dogs'' a_b_ c__ d_e <b> ab> a>\u0338 b=\u0338 İ*** ǅ)] x<|endoftext|>.) y<|endoftext|>> 5%% .. ,*** é\u0301.)! ñ\u0303\"", "end.!! end***"]])
def test_chunks_encode_as_whole_texts(extra):
    texts = SOME + extra
    ids, ends = token_codes.ChunkEncoder(WORD_BPE).encode(pa.array(texts), 2)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_chunks_remember_what_comes_again(monkeypatch):
    monkeypatch.setattr(token_codes, "REMEMBERED", 300)
    learned = Counter()
    learn = token_codes.ChunkEncoder._learn

    def counted(self, chunks):
        learned.update(chunks)
        learn(self, chunks)

    monkeypatch.setattr(token_codes.ChunkEncoder, "_learn", counted)
    encoder = token_codes.ChunkEncoder(WORD_BPE)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    common = "the quick brown fox, jumps über 12 lazy dogs."
    for n in range(20):
        texts = [common, " ".join(f"{chr(97 + n)}{chr(97 + i % 26)}{chr(97 + i // 26)}" + "xyz."[: i % 5] for i in range(120)), None]
        ids, ends = encoder.encode(pa.array(texts), 2)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert len(encoder.known) < 300 + 150
    assert {learned[w] for w in ("the", "quick", "fox", "über", "12", "dogs")} == {1}
    assert sum(learned.values()) > 2 * 300  # more than it remembers


@pytest.mark.parametrize("change", ["cut", "added"])
def test_small_words_of_another_tokenizer(tmp_path, change):
    from tokenizers import AddedToken, Regex, Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(WORD_BPE)
    assert token_codes.ChunkEncoder(WORD_BPE).plain
    if change == "cut":  # words are cut behind an s
        whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("s"), "merged_with_previous"), whole.pre_tokenizer])
    else:
        whole.add_tokens([AddedToken("row", normalized=False)])
    whole.save(path := str(tmp_path / "other.json"))
    encoder = token_codes.ChunkEncoder(path)
    assert not encoder.plain
    texts = ["brown mississippi, arrows grow", "rows"]
    ids, ends = encoder.encode(pa.array(texts), 2)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_token_files(spark, awkward, nothing):
    folder = new_folder(spark, "test")
    token_codes.write_tokens(awkward, folder, WORD_BPE, 2, segment_tokens=500)
    rows = token_codes.read_tokens(spark, folder).orderBy("start").collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in rows) == Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in TEXTS)
    assert [r.start for r in rows] == np.cumsum([0] + [len(r.tokens) for r in rows])[:-1].tolist()
    digests = {r.start: r for r in token_codes.read_digests(spark, folder).collect()}
    assert all(digests[r.start].ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows)
    long = next(r for r in rows if r.doc_id == 7)
    wanted = spark.createDataFrame([(7, p) for p in (0, 5, len(long.tokens) - 1, len(long.tokens), -1)], "doc_id long, position long")
    for most_sent in (token_codes.MOST_SENT, 0):
        found = token_codes.tokens_at(spark, folder, wanted.union(wanted), most_sent)
        assert sorted((r.position, r.token) for r in found.collect()) == [(p, long.tokens[p]) for p in (0, 5, len(long.tokens) - 1)]
    plan = token_codes.tokens_at(spark, folder, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "segment#" in plan.split("Filter")[1]  # the scan is told which segments
    empty = new_folder(spark, "test")
    token_codes.write_tokens(nothing, empty, WORD_BPE, 2)
    assert token_codes.read_digests(spark, empty).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@given(texts=st.lists(st.text(st.sampled_from("ab e's.\n\t1\x1c\x85\u00a0é漢!"), max_size=40) | st.text(max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_as_tiktoken(texts, bpe, tiktoken_encoding):
    ids, ends = bpe.encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_bpe_of_long_pre_tokens(bpe, tiktoken_encoding):
    texts = ["a" * 5000, "abcd" * 3000, " " * 999 + "x", "é" * 4000, "".join(chr(97 + i * i % 26) for i in range(9000)), " " + "ab" * 70 + "\n"]
    ids, ends = bpe.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_bpe_of_tables(spark, awkward, nothing, tiktoken_encoding):
    both = byte_bpe.decode(byte_bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = both.collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == Counter((i, tuple(tiktoken_encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, RANKS).collect()] == [b"", b""]


# Quality classifier


def test_rules_are_tightened():
    rule = (("a", "<=", 3.0), ("b", ">", 1.0), ("a", "<=", 2.0), ("b", ">", 4.0))
    assert rule_ensemble.tidy(rule) == (("a", "<=", 2.0), ("b", ">", 4.0))


def test_classifier_learns_and_keeps_columns(spark, awkward, nothing):
    clean = [(100 + i, " ".join(f"word{(i * 7 + j * j) % 211}" for j in range(40 + i % 50)) + ".") for i in range(150)]
    junk = [(400 + i, "BUY " * (30 + i % 40) + "!!! " * 9) for i in range(150)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (401, None, 0)], "doc_id long, quality int, toxic int")
    model = rule_ensemble.learn(docs, labels)
    assert model.weights and len(model.weights) < 60 and model.describe()
    scored, name = rule_ensemble.add_score(docs, model)
    held_out = scored.where(rule_ensemble.is_held_out(F.col("doc_id"))).collect()
    assert np.mean([(r[name] >= 0.5) == (r.doc_id < 400) for r in held_out]) > 0.97
    wide, name = rule_ensemble.add_score(awkward, model)
    assert name == "_score" and wide.columns == [*awkward.columns, "_score"] and wide.count() == len(TEXTS)
    assert all(0 <= r[name] <= 1 for r in wide.collect())
    assert rule_ensemble.drop_rejected(awkward, model).columns == awkward.columns
    assert rule_ensemble.drop_rejected(nothing, model).count() == 0
    one_sided = rule_ensemble.learn(docs, labels.where("quality = 1"))
    assert not one_sided.weights and rule_ensemble.learn(nothing, labels.limit(0)).intercept == 0


def test_no_label_of_a_held_out_document_is_learned(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string")
    rows = rule_ensemble.labelled_rows(docs, docs.selectExpr("doc_id", "1 as quality"), most=25).collect()
    assert len(rows) == 25 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)


# Quality rules


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    threes = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_and_verdicts(spark, awkward, nothing):
    rows = quality_rules.judge(awkward, min_group=2).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *brute_counts(t)) for i, t in TEXTS)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0


def test_fences_follow_the_source(spark):
    words = lambda i, n=60: [f"w{(i * 31 + j * j * 7 + j) % 4001}" for j in range(n)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(words(i)), "en", "plain"))
        rows.append((1000 + i, " | ".join(words(i)), "en", "tables"))
    rows.append((5000, " | ".join(words(5)), "en", "plain"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300)) and not got[5000]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=50))
@settings(max_examples=5, deadline=None)
def test_bins_are_near(values):
    for v in values:
        shift = max(0, v.bit_length() - 5)
        low = v >> shift << shift
        assert low <= v < low + max(1, low / 16 + 1)


def test_bins_in_spark(spark):
    values = [0, 1, 31, 32, 33, 34, 63, 64, 999, 1000, 123456]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bin_of(F.col("v")).alias("b")).collect()
    assert [(r.v, r.b) for r in rows] == [(v, v >> max(0, v.bit_length() - 5) << max(0, v.bit_length() - 5)) for v in values]


# Substring deduplication


def brute_repeats(docs, width):
    first, kept = {}, {}
    for key, words in docs:
        gone = set()
        for s in range(len(words) - width + 1):
            if first.setdefault(tuple(words[s : s + width]), (key, s)) != (key, s):
                gone.update(range(s, s + width))
        kept[key] = " ".join(w for i, w in enumerate(words) if i not in gone)
    return kept


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_as_brute_force(spark, monkeypatch, hot):
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(45)]
    docs = []
    for i in range(60):
        words = [f"v{x}" for x in rng.integers(0, 40, rng.integers(0, 120))]
        if i % 3 == 0:
            at = rng.integers(0, len(words) + 1)
            words = words[:at] + passage[: rng.integers(15, 45)] + words[at:]
        if i % 7 == 0:
            words = words + ["x"] * 50 + words
        docs.append((i, words))
    if hot:
        monkeypatch.setattr(superkmers, "hot_minimisers", lambda d, w: np.unique(superkmers.super_kmers(superkmers.word_hashes([w.encode() for _, ws in docs for w in ws]), np.repeat(np.arange(60), [len(ws) for _, ws in docs]), 20)[2])[::2])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in superkmers.mark_repeats(df, 20).collect()}
    assert {i: r.kept for i, r in got.items()} == brute_repeats(docs, 20)
    assert all(got[i].n_words == len(w) and got[i].n_removed == len(w) - len(got[i].kept.split()) for i, w in docs)


def test_hash_chance_is_checked(monkeypatch):
    monkeypatch.setattr(superkmers, "gram_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    assert superkmers.repeated_windows(ids, np.arange(7), 3).tolist() == [0, 1, 2, 3, 4, 5, 0]


def test_repeats_of_awkward_tables(spark, awkward, nothing):
    rows = superkmers.mark_repeats(awkward, 5).collect()
    assert len(rows) == len(TEXTS) and superkmers.mark_repeats(nothing).count() == 0
    same = {(r.kept, r.n_removed) for r in rows if r.doc_id == 2 and r.n_words == 14}
    assert same == {("Another text with the same id; it is not the same document at all.", 0)}
    second = next(r for r in rows if r.doc_id == 2 and r.n_words == 54)
    assert second.kept == "" and second.n_removed == 54


# Chat formatting


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", ""]), st.text(st.sampled_from("\\#<>:/bhlc \n"), max_size=12) | st.sampled_from(["</turn>\n", "### ", "</part>\n", ":\n"])), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None)
def test_chats_come_back(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    got = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert [(t.role, t.text) for t in got.turns] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")


def test_chats_of_awkward_tables(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", None, 0), (1, 2, "assistant", "a", 0), (1, 2, "assistant", "a", 0), (None, None, None, None, 0), (3, 0, "user", LONG, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[1].formatted.count("### assistant") == 1 and got[1].loss_text == "aab"
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[3].turns[0].text == LONG
    assert chat.format_chats(turns.limit(0)).count() == 0


# Decontamination

NORMAL = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]


def brute_matches(text, item):
    doc, own = NORMAL(text or ""), NORMAL(item or "")
    if not own:
        return 0.0
    k = min(5, len(own))
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    theirs, best = Counter(grams(own)), 0.0
    for at in range(len(doc) - len(own) + 1):
        mine = Counter(grams(doc[at : at + len(own)]))
        best = max(best, sum((mine & theirs).values()) / sum((mine | theirs).values()))
    return best


def test_contamination_as_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"t{rng.integers(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(15, 60)))) for i in range(30)] + [(90, "tiny item"), (91, ""), (92, None), (93, "one two three four five")]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.integers(0, 200))]
        if d % 2:
            passage = items[d % 30][1].split()
            if d % 4 == 3:
                passage[rng.integers(0, len(passage))] = word()
            at = rng.integers(0, len(words) + 1)
            words = words[:at] + passage[: len(passage) - d % 5 // 2] + words[at:]
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words)))
    docs += [(900, "A tiny, item!"), (901, None), (902, ""), (None, items[0][1])]
    want = {(d, i) for d, t in docs for i, x in items if brute_matches(t, x) >= 0.8}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(*frames).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 30
    assert {(r.doc_id, r.item_id, r.similarity) for r in got if r.similarity == 1} == {(d, i, 1.0) for d, t in docs for i, x in items if brute_matches(t, x) == 1}
    marked, name = decontaminate.add_matches(*frames, block_items=7)
    blocks = {(r.doc_id, m.item_id) for r in marked.collect() for m in r[name]}
    assert blocks == found
    kept = {r.doc_id for r in decontaminate.drop_contaminated(*frames).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=18))
@settings(max_examples=60, deadline=None)
def test_blocks_miss_nothing_within_the_radius(prints, _, flips):
    index = decontaminate.Index([], 0.8)
    group = {"ids": list(range(len(prints))), "prints": np.array(prints, np.uint64), "tables": []}
    for lo, hi in zip(index.edges, index.edges[1:]):
        part = index._part(group["prints"], lo, hi)
        order = np.argsort(part, kind="stable")
        group["tables"].append((order, np.searchsorted(part[order], np.arange((1 << (hi - lo)) + 1))))
    probe = prints[0]
    for f in flips:
        probe ^= 1 << f
    _, items = index.within_radius(group, np.array([probe], np.uint64))
    assert set(items.tolist()) == {i for i, p in enumerate(prints) if (p ^ probe).bit_count() <= 18}


def test_contamination_of_awkward_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, TEXTS[2][1])], "item_id long, text string")
    marked, name = decontaminate.add_matches(awkward, items)
    assert name == "_matches" and sorted(r.doc_id for r in marked.where("size(_matches) > 0").collect()) == [2, 2]
    assert decontaminate.drop_contaminated(awkward, items).columns == awkward.columns
    assert decontaminate.drop_contaminated(awkward, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.contamination(nothing, items).count() == 0


# Licences


def test_license_expressions():
    evaluate = lambda e: licenses.evaluate(licenses.to_postfix(e))
    assert evaluate("MIT OR GPL-2.0-only AND Apache-2.0") == (frozenset({"mit", "gpl-2.0-only", "apache-2.0"}), "(mit or (gpl-2.0-only and apache-2.0))", True)
    assert evaluate("(MIT OR X) AND GPL-3.0 WITH Classpath-exception-2.0")[1:] == ("((mit or x) and (gpl-3.0 with classpath-exception-2.0))", False)
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT GPL", "()"):
        with pytest.raises(licenses.BadExpression):
            licenses.to_postfix(bad)


def test_license_scan(spark, awkward, nothing):
    rows = [
        (1, "Released under the MIT-License. mit license mit\nLICENSE"), (2, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode"),
        (3, "spdx-license-identifier: MIT AND"), (4, "submit license permit licenses"), (5, "GNU Lesser General Public License"), (6, "K mit license"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 7, "mit")
    assert got[2].labels == "spdx:apache-2.0,spdx:mit" and got[2].permissive and got[2].score == 0.9 and got[2].n_base == 0
    assert got[3].score == 0.5 and got[3].permissive is None and got[4].labels == ""
    assert got[5].base_labels == "gpl" and got[5].labels == "gpl,lgpl" and 0 < got[5].score < 1
    assert got[6].first_word == 1
    assert licenses.scan(awkward).count() == len(TEXTS) and licenses.scan(nothing).count() == 0


# Personal data


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@given(st.text(st.sampled_from("a.@-+ 0149()2é%"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_cards():
    text = "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111"
    assert pii.base_spans(text) == plain_base(text) and [s[0] for s in plain_base(text)] == ["card", "card"]


def made_text(rng, i):
    filler = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(5, 30)))
    data = [f"{filler().split()[0]}.{i}@mail{i % 10}.example.com", f"{i % 200}.{i % 90}.7.{i % 250}", f"+1 ({200 + i % 700}) 555-{1000 + i}"][i % 3]
    return f"{filler()} {data} {filler()}"


def test_tagger_gradient_is_right():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    windows, tags = rng.integers(0, pii.CLASSES, (3, 9)), np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0]] * 3)
    loss, g = tagger.gradient(windows, tags)
    for k in tagger.p:
        at = tuple(rng.integers(0, n) for n in tagger.p[k].shape)
        if k == "E":
            at = (int(windows[0, 0]), 0)
        if k == "T":
            at = (1, 2)
        keep = tagger.p[k][at]
        tagger.p[k][at] = keep + 1e-4
        up = tagger.gradient(windows, tags)[0]
        tagger.p[k][at] = keep - 1e-4
        down = tagger.gradient(windows, tags)[0]
        tagger.p[k][at] = keep
        assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, k


def test_tagger_learns_and_adds(spark, nothing):
    rng = np.random.default_rng(2)
    texts = [made_text(rng, i) for i in range(300)]
    tagger = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    held = [made_text(rng, 1000 + i) for i in range(60)]
    windows, tags = pii.examples(held)
    got, _ = tagger.decode(windows)
    assert (got == tags).mean() > 0.97
    found = pii.find_spans(tagger, held)
    assert all([s[:3] for s in f if s[3]] == pii.base_spans(t) for f, t in zip(found, held))
    hidden = ["abc def write to gfhb.7 @ mail3.example.com today abc", "call 001 (415) 555-1234 now abcd"]
    assert sum(len(s) for s in pii.find_spans(tagger, hidden)) >= 1
    assert pii.find_spans(tagger, ["no data in here, Version without any"]) == [[]]
    untrained = pii.learn(nothing)
    assert pii.find_spans(untrained, [texts[0]]) == [[(*s, True) for s in pii.base_spans(texts[0])]]


def test_redaction_keeps_tables(spark, awkward, nothing):
    tagger = pii.learn(nothing)
    out = pii.redact(awkward, tagger, chars_col="n_chars")
    assert out.schema == awkward.schema
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(TEXTS)
    one = spark.createDataFrame([(1, "mail a.b@c.de or +44 20 7946 0958 x", 0)], "doc_id long, text string, n_chars int")
    row = pii.redact(one, tagger, chars_col="n_chars").collect()[0]
    assert row.text == "mail [EMAIL] or [PHONE] x" and row.n_chars == len(row.text)
    assert pii.add_spans(nothing, tagger).count() == 0
    named = pii.add_spans(awkward.withColumnRenamed("score", "spans"), tagger)
    assert named.columns[-1] == "_spans" and [r.spans for r in named.collect()] == ["y"] * awkward.count()


# Jaccard join


def brute_classes(docs, threshold=0.8):
    def shingles(t):
        w = NORMAL(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    forms = {}
    for i, t in docs:
        forms.setdefault(t or "", []).append(i)
    keys = list(forms)
    sets = [shingles(t) for t in keys]
    links = [[j for j in range(len(keys)) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(keys))]
    label = list(range(len(keys)))
    for _ in keys:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(keys))]
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(label[i], []).extend(x for x in forms[k] if x is not None)
    return Counter((i, min(least[label[n]], default=None), len(links[n]), len(forms[k])) for n, k in enumerate(keys) for i in forms[k])


def near_copies(groups=12, size=9):
    rng = np.random.default_rng(6)
    docs = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.integers(30, 120))]
        for c in range(size):
            words = list(base)
            for _ in range(c % 4):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10**6)}"
            docs.append((len(docs) * 3, " ".join(words)))
    return docs + [(i, t) for i, t in TEXTS if t != LONG] + [(800, "short text"), (801, "Short, text!"), (802, "short texts")]


@pytest.mark.parametrize("block", [1024, 4])
def test_classes_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = near_copies()
    rows = jaccard_join.document_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows) == brute_classes(docs)


def test_one_document_of_each_class_stays(spark, awkward, nothing):
    docs = near_copies(4, 5)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, stay_key string")
    kept = jaccard_join.keep_one(df).collect()
    want = Counter(k[1] for k in brute_classes(docs))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(k for k in want if k is not None)
    out = jaccard_join.keep_one(awkward)
    assert out.columns == awkward.columns and Counter(r.doc_id for r in out.collect())[2] == 1
    assert jaccard_join.keep_one(nothing).count() == 0 and jaccard_join.document_classes(nothing).count() == 0


def test_depth_reaches_the_recall():
    for target in (0.5, 0.9, 0.99, 0.9995):
        trees, d = jaccard_join.forest(0.8, 16, 8, target)
        assert 1 - (1 - 0.8**d) ** trees >= target
        assert d == 8 or 1 - (1 - 0.8 ** (d + 1)) ** 16 < target


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12))
@settings(max_examples=60, deadline=None)
def test_overlaps(sets):
    got = jaccard_join.overlaps([np.array(sorted(s), np.uint64) for s in sets])
    for i in range(len(sets)):
        for j in range(len(sets)):
            if i != j:
                assert got[i, j] == len(sets[i] & sets[j])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(200, 200)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {j: 100 for j in range(101, 130)}


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@given(st.lists(st.binary(max_size=60), max_size=12), st.integers(1, 80))
@settings(max_examples=60, deadline=None)
def test_a_shared_queue_merges_each_string_alone(strings, size):
    """Also for a table whose merges make pairs of lower ranks."""
    ranks = {bytes([b]): b + 40 for b in range(256)}
    made = [b"ab", b"bc", b"abab", b"aa", b"aaa", b"cab", b"abc", b"aaaa", b"ba", b"bab", b"\x00\x01", b"\x00\x01\x00"]
    ranks |= {token: 300 + (7 * k) % len(made) if k % 2 else k for k, token in enumerate(made)}
    merger = byte_bpe.Merger(ranks)
    strings = strings + [s.translate(bytes(97 + b % 3 for b in range(256))) for s in strings]

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    before, byte_bpe.BUFFER_BYTES = byte_bpe.BUFFER_BYTES, size
    try:
        ids, counts = merger.encode_all(strings)
    finally:
        byte_bpe.BUFFER_BYTES = before
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [plain(s) for s in strings]
    assert not any(merger.low)


@given(st.lists(st.binary(max_size=60), max_size=12), st.sampled_from([1, 2, 5]), st.integers(0, 1000))
@settings(max_examples=300, deadline=None)
def test_large_buckets_merge_each_string_alone(strings, bulk, seed):
    """Like one pair after another, for tables whose merges also make pairs of lower ranks."""
    made = [b"ab", b"bc", b"abab", b"aa", b"aaa", b"cab", b"abc", b"aaaa", b"ba", b"bab", b"ca", b"aab", b"abb", b"cc", b"abcab", b"caab"]
    order = np.random.default_rng(seed).permutation(len(made)).tolist()
    ranks = {bytes([b]): b + 40 for b in range(256)} | {token: 300 + k if k % 2 else k for token, k in zip(made, order)}
    merger = byte_bpe.Merger(ranks)
    strings = strings + [s.translate(bytes(97 + b % 3 for b in range(256))) for s in strings] + [b"a" * 9, b"abab" * 4, b"", b"cabcabaab" * 3]

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    before, byte_bpe.BULK = byte_bpe.BULK, bulk
    try:
        ids, counts = merger.encode_all(strings)
    finally:
        byte_bpe.BULK = before
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [plain(s) for s in strings]
    assert not any(merger.low) and not any(merger.buckets)


def test_large_buckets_are_not_merged_one_by_one(bpe, tiktoken_encoding, monkeypatch):
    single, real = [], byte_bpe.Merger._merge_each
    monkeypatch.setattr(byte_bpe.Merger, "_merge_each", lambda self, parts, now, bucket, top: single.append(len(bucket)) or real(self, parts, now, bucket, top))
    words = [f"thering{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}xation" for i in range(5_000)]
    ids, counts = bpe.merger.encode_all([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [tiktoken_encoding.encode_ordinary(w) for w in words]
    assert sum(single) < 10_000  # of more than 50,000


def test_bpe_remembers_what_comes_again(tiktoken_encoding, monkeypatch):
    """Also after its memory was full; what came once is forgotten."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 400)
    encoder, merged = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN), Counter()
    real = encoder.merger.encode_all
    monkeypatch.setattr(encoder.merger, "encode_all", lambda strings: merged.update(strings) or real(strings))
    often = " ".join(f"oftenseen{chr(97 + i % 26)}zq{chr(97 + i // 26)}, it's" for i in range(60))
    for k in range(40):
        texts = [f"{often} once{k}xq" + " ".join(f"rarewo{chr(97 + i)}rd{chr(97 + k % 26)}q{'z' * (k // 26)}" for i in range(25)), "odd \n " * (k % 3), None, often]
        ids, ends = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tiktoken_encoding.encode_ordinary(t or "") for t in texts]
        assert len(encoder.known) <= 700
    assert max(merged[f" oftenseen{chr(97 + i % 26)}zq{chr(97 + i // 26)}".encode()] for i in range(1, 60)) == 1


def test_parts_of_spans_are_joined_over_windows():
    email, phone = "email", "phone"
    runs = [
        (email, 40, 96, 0.9, False, True), (email, 48, 144, 1.0, True, True), (email, 96, 150, 1.0, True, False),  # one long span
        (phone, 10, 20, 0.95, False, False), (phone, 90, 96, 0.9, False, True),  # the second goes on nowhere
        (email, 300, 310, 0.9, True, False),  # its beginning is nowhere
    ]
    got = pii.joined(runs)
    assert sorted((a, b, k) for _, a, b, k in got) == [(10, 20, phone), (40, 150, email)]
    assert [q for q, a, *_ in got if a == 40][0] == pytest.approx((56 * 0.9 + 96 + 54) / 206, abs=5e-3)


SMALL_TEXTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not Path(SMALL_TEXTS).exists(), reason="driver tables not present")
def test_few_texts_teach_the_tagger_and_long_spans_are_found():
    """Learned from the first texts of a small table, it finds rewritten emails in others, also much longer ones."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(SMALL_TEXTS, columns=["text"]).column(0).to_pylist() if t and pii.base_spans(t)]
    with_email = [t for t in texts if any(k == "email" for k, *_ in pii.base_spans(t))]
    held = with_email[::2]
    tagger = pii.Tagger()
    tagger.train(*pii.examples([t[:4000] for t in texts if t not in held]))
    rng = np.random.default_rng(1)
    # Those of 400 characters are longer than any it learned from: joined from many windows.
    for length, share in ((0, 0.9), (40, 0.9), (120, 0.9), (400, 0.8)):
        found = 0
        for text in held:
            _, a, b = next(s for s in pii.base_spans(text) if s[0] == "email")
            name, domain = text[a:b].split("@", 1)
            while len(name) + len(domain) + 3 < length:
                name += "." + "office"
            part = pii.disguised("email", f"{name}@{domain}", rng)
            spans = pii.find_spans(tagger, [text[:a] + part + text[b:]])[0]
            found += ("email", a, a + len(part)) in [s[:3] for s in spans]
        assert found >= share * len(held) > 3, length


def test_many_repeated_lines_are_told_apart(spark):
    """Where a hundred repeated lines are common, a text with thousands is still over the fence."""
    plain = [" ".join(f"word{n}x{k}" for k in range(60)) + "\n" + "same line here\n" * (96 + n % 5) for n in range(300)]
    docs = spark.createDataFrame([(n, "en", "s", t) for n, t in enumerate([*plain, plain[0] + "same line here\n" * 20_000])], "doc_id long, lang string, source string, text string")
    rates = quality_rules.with_rates(quality_rules.with_counts(docs))
    fence = quality_rules.fences(quality_rules.sketches(rates)).where("level = 0").first().dup_rate_fence
    over = [r.doc_id for r in rates.where(F.col("dup_rate") > fence).collect()]
    assert over == [300] and fence > 100 * 25


def test_a_forest_reaches_its_recall_at_every_threshold():
    for similarity in (0.2, 0.3, 0.5, 0.6, 0.8, 0.9, 1.0):
        trees, depth = jaccard_join.forest(similarity)
        assert depth >= min(2, jaccard_join.DEPTH) and 1 - (1 - similarity**depth) ** trees >= jaccard_join.TARGET_RECALL
        if trees == jaccard_join.TREES and depth < jaccard_join.DEPTH:
            assert 1 - (1 - similarity ** (depth + 1)) ** trees < jaccard_join.TARGET_RECALL
    with pytest.raises(ValueError):
        jaccard_join.forest(0.01)


def test_links_of_a_low_threshold_are_found(spark):
    """At 0.3, where the trees of 0.8 would miss links, more trees find those of brute force."""
    rng = np.random.default_rng(2)
    docs = []
    for n in range(40):
        words = [f"w{n}x{k}" for k in range(60)]
        other = words[: 25 + n % 20] + [f"o{n}x{k}" for k in range(35 - n % 20)]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in jaccard_join.document_classes(spark.createDataFrame(docs, "doc_id long, text string"), 0.3).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in docs}
    for n in range(40):
        a, b = sets[2 * n], sets[2 * n + 1]
        assert (got[2 * n + 1] == 2 * n) == (len(a & b) >= 0.3 * len(a | b))


@pytest.mark.parametrize("n", [1, 127, 128, 129, 300, 2000])
def test_long_conversations_come_back(spark, n):
    """Formatting and reading of many turns, in runs that the sums and cuts are made of."""
    rows = [(1, i, ("user", "assistant", "assistant", "tool")[i * i % 4], f"#{i}<é\\" * (i % 3)) for i in range(n)]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = chat.read_chats(formatted).first()
    assert [(t.role, t.text) for t in read.turns] == [(r, t) for _, _, r, t in rows]
    assert read.loss_text == "".join(t for _, _, r, t in rows if r == "assistant")
    spans = formatted.first().loss_spans
    assert [s.start for s in spans] == sorted(s.start for s in spans) and all(0 <= s.start < s.end <= len(read.formatted) for s in spans)


@given(st.lists(st.sampled_from("mit license apache general public lesser affero bsd creative commons x é 1 MIT License. general-public -- by cc nc".split(" ") + ["", "\n"]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_notices_are_found_wherever_their_words_stand(parts):
    text = " ".join(parts)
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def places(phrase):
        own = phrase.split()
        return [i for i in range(len(words)) if words[i : i + len(own)] == own]

    n_words, n_base, first, last, base, labels, score, *_ = licenses.Scanner().scan(text)
    found = sorted(i for p in licenses.BASE_PHRASES for i in places(p))
    assert (n_words, n_base) == (len(words), len(found))
    assert (first, last) == ((found[0], found[-1]) if found else (None, None))
    assert base == ",".join(sorted({label for p, label in licenses.BASE_PHRASES.items() if places(p)}))
    every = {label for p, label in {**licenses.BASE_PHRASES, **licenses.MORE_PHRASES}.items() if places(p)}
    assert labels == ",".join(sorted(every)) and (score > 0) == bool(every)


def test_expressions_have_listed_identifiers_only():
    written = lambda t: licenses.evaluate(licenses.read_expression(t))[1:]
    assert written("MIT and other words follow") == ("mit", True)
    assert written("(GPL-2.0+ WITH Classpath-exception-2.0 OR Apache-2.0) AND MIT or more") == ("(((gpl-2.0+ with classpath-exception-2.0) or apache-2.0) and mit)", True)
    assert written("LicenseRef-own-1 OR MPL-2.0") == ("(licenseref-own-1 or mpl-2.0)", False)
    assert written("GPL-2.0-only WITH MIT") == ("gpl-2.0-only", False)
    for bad in ("", "the", "Classpath-exception-2.0", "AND MIT", ") MIT", "Hello-1.0 OR MIT", "( MIT", "MIT OR", "MIT WITH"):
        with pytest.raises(licenses.BadExpression):
            licenses.read_expression(bad)


def test_every_pair_of_operators_is_evaluated_as_by_hand():
    """Against truth tables of all expressions of three identifiers and two operators."""
    names = ["mit", "gpl-3.0", "isc"]
    truth = {n: n in licenses.PERMISSIVE for n in names}
    for a in names:
        for b in names:
            for c in names:
                for x in ("or", "and"):
                    for y in ("or", "and"):
                        for text in (f"{a} {x} {b} {y} {c}", f"({a} {x} {b}) {y} {c}", f"{a} {x} ({b} {y} {c})"):
                            plain = re.sub(r"[a-z0-9.\-]+", lambda m: m.group() if m.group() in ("or", "and") else str(truth[m.group()]), text)
                            assert licenses.evaluate(licenses.read_expression(text.upper()))[2] == eval(plain)


def test_bpe_takes_few_bytes_at_once(spark, monkeypatch):
    class Rows:  # stands for a table, and keeps the function that Spark would run in a worker
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    texts = [None if i == 5 else "text 1 " * 400_000 if i == 7 else f"text {i % 9} " * (i % 2_000) for i in range(1_000)]  # 7 MB and a long one
    sizes, real = [], byte_bpe.Encoder.encode
    monkeypatch.setattr(byte_bpe.Encoder, "encode", lambda self, column: sizes.append((len(column), sum(len(t or "") for t in column.to_pylist()))) or real(self, column))
    encode = byte_bpe.encode(Rows(), RANKS, public_tokenizers.PATTERN).run
    decode = byte_bpe.decode(Rows(), RANKS).run
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts)], names=["doc_id", "text"])
    got = [(i, d.decode()) for b in decode(encode([batch, batch.slice(0, 0)])) for i, d in zip(b.column("doc_id").to_pylist(), b.column("decoded").to_pylist())]
    assert got == [(i, t or "") for i, t in enumerate(texts)]
    assert sum(n for n, _ in sizes) == 1_000 and all(size <= 2_500_000 or n == 1 for n, size in sizes)
