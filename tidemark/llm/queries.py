"""A query for each operator over the driver's tables, and oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import (
    byte_bpe, centroids, chat, decontaminate, hard_negatives, jaccard_join, language_id, licenses, pii, quality_rules, rule_ensemble, superkmers, token_codes
)
from tidemark.llm.shared import new_folder, text_of

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_codes.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_codes.read_digests(spark, folder)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.learn(docs, table(spark, sf_dir, "labels"))
    scored, score = rule_ensemble.add_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", rule_ensemble.is_held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted")
    )


def adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = superkmers.mark_repeats(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def planted_turns(spark: SparkSession) -> DataFrame:
    """A conversation whose texts look like a template's marks."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = chat.read_chats(chat.format_chats(turns.unionByName(planted_turns(spark))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BYTE_RANKS)
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def joined_spans(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    found = pii.add_spans(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.document_classes(table(spark, sf_dir, "documents"))


def language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": token_files,
    "op2_rule_ensemble": quality_classifier,
    "op3_adaptive_rules": adaptive_rules,
    "op4_superkmer_dedup": substring_dedup,
    "op5_chat_formatting": chat_formatting,
    "op6_simhash_decontamination": decontamination,
    "op7_byte_bpe": byte_level_bpe,
    "op8_license_scan": license_scan,
    "op9_personal_data": personal_data,
    "op10_jaccard_join": jaccard_classes,
    "op11_language_id": language_identification,
    "op12_hard_negatives": hard_negative_mining,
    "op13_centroid_clusters": centroid_clustering,
    "pipeline": pipeline,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ADAPTIVE_SQL = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 3) AS r(j) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_rate, n_dup_lines * 25 AS dup_rate,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate, coalesce(10 * word_chars // nullif(n_words, 0), 0) AS word_tenths,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c),
one AS (
  SELECT doc_id, lang, source, stat, value FROM (
    SELECT doc_id, lang, source, unnest(['symbol_rate', 'dup_rate', 'repeat_rate', 'word_tenths']) AS stat,
      unnest([symbol_rate, dup_rate, repeat_rate, word_tenths]) AS value FROM r)),
binned AS (
  SELECT *, (value // (1 << greatest(0, length(bin(value)) - 5))) * (1 << greatest(0, length(bin(value)) - 5)) AS b FROM one),
levels AS (
  SELECT 0 AS level, lang, source, stat, b FROM binned UNION ALL SELECT 1, lang, NULL, stat, b FROM binned UNION ALL SELECT 2, NULL, NULL, stat, b FROM binned),
sketch AS (SELECT level, lang, source, stat, b, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, stat ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, stat) AS total FROM sketch),
q AS (
  SELECT level, lang, source, stat, max(total) AS n, min(b) FILTER (upto * 100 >= total * 50) AS mid, min(b) FILTER (upto * 100 >= total * 75) AS high
  FROM ranked GROUP BY ALL),
f AS (
  SELECT level, lang, source, stat, n,
    mid + 8 * greatest(high - mid, CASE stat WHEN 'symbol_rate' THEN 5 WHEN 'dup_rate' THEN 25 WHEN 'repeat_rate' THEN 50 ELSE 3 END) AS fence FROM q),
v AS (
  SELECT one.doc_id, bool_or(value > coalesce(f0.fence, f1.fence, f2.fence)) AS over
  FROM one
  LEFT JOIN f f0 ON f0.level = 0 AND f0.n >= 200 AND f0.stat = one.stat AND f0.lang IS NOT DISTINCT FROM one.lang AND f0.source IS NOT DISTINCT FROM one.source
  LEFT JOIN f f1 ON f1.level = 1 AND f1.n >= 200 AND f1.stat = one.stat AND f1.lang IS NOT DISTINCT FROM one.lang
  JOIN f f2 ON f2.level = 2 AND f2.stat = one.stat
  GROUP BY one.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM r JOIN v USING (doc_id)
"""

SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(s)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM later, range(0, 20) AS r(j)),
placed AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (
  SELECT placed.doc_id, string_agg(word, ' ' ORDER BY placed.p) AS kept, count(*) AS n
  FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p WHERE gone.p IS NULL GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (
  SELECT *, length(text) + 1 * (length(text) - length(translate(text, '\#<', ''))) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS more FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN more THEN 8 ELSE 4 + length(role) + length(role) - length(translate(role, '\#<:', '')) + 2 + 8 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE forms AS (
  SELECT md5(coalesce(text, '')) AS k, min(doc_id) AS rep, count(*) AS copies, min(lower(coalesce(text, ''))) AS t FROM documents GROUP BY 1),
words AS (
  SELECT k, list_filter(string_split(regexp_replace(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM forms),
s AS (SELECT DISTINCT k, array_to_string(ws[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT k, k FROM forms UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS k, min(rep) AS class_id FROM reach JOIN forms ON forms.k = reach.b GROUP BY 1),
degree AS (SELECT a AS k, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(degree.n, 0)::BIGINT AS n_links, copies AS n_copies
FROM documents JOIN forms ON forms.k = md5(coalesce(text, '')) JOIN class ON class.k = forms.k LEFT JOIN degree ON degree.k = forms.k
"""

FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

NEGATIVES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE_SQL}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


def clusters_sql(rounds: int = 10) -> str:
    """Rounds of assignment and means, one after another."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND {FINITE_SQL})",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INT AS c, q FROM (SELECT q, sha256('3:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL) ORDER BY h, q LIMIT 8)",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v.q, c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
            f"FROM v, c{r} k QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.q ORDER BY d, c) = 1)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i)::BIGINT[] AS q FROM "
                f"(SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN m{r} m USING (c))")
    last = rounds
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} k USING (c)"""
    )


ORACLES = {
    "op3_adaptive_rules": ADAPTIVE_SQL,
    "op4_superkmer_dedup": SUBSTRING_SQL,
    "op5_chat_formatting": CHAT_SQL,
    "op10_jaccard_join": JACCARD_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_centroid_clusters": clusters_sql(),
}
