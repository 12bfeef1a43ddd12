"""The queries of the operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import _text, fingerprints, language_id, merkle, packing, pii, point_in_time, quality_gam, quality_rules, sentencepiece_codec, sharding, simhash, substring_dedup, token_rollup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the labelled rows that aren't held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_gam.fit(docs, labels.where(_text.crc_mod(F.col("doc_id"), 4) != 2))
    scored = quality_gam.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_text.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts and a digest of the patterns' spans, and all spans with those that the field adds.

    Null and empty texts have no spans; repeated rows are judged each; rows with a null doc_id stay.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated passages of 50 words cover, counted and cut out of every whole text but the smallest doc_id's.

    Null texts have no words; rows that share a doc_id keep their common passages; null doc_ids count as larger than all others.
    """
    return substring_dedup.dedup_digests(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with an end id and decoded again, as digests. Null texts are empty ones; repeated rows are encoded each."""
    return sentencepiece_codec.round_trip_digests(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every whole text and the verdict of the cascade. Null and empty texts have no words and fail; repeated rows are judged each."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("q_words") < 20) | (100 * F.col("q_repeat_words") > 30 * F.col("q_words"))
    return judged.select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & F.col("kept")).alias("kept"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every whole text and its edited form, likeness to both, and the group of texts with the same canonical bytes.

    Null texts are empty ones; rows without a doc_id come last in the order of documents; equal rows follow one another.
    """
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles and the components of those within four bits.

    Null texts, and others without words, have the fingerprint zero; rows without a doc_id take part and don't name a component.
    """
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as pieces in sequences of up to 2,048 words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, token_rollup.words_count(F.col("text")))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by two tokenizers, as batches bring them in, take them back and revise them.

    All documents come in under words-1, a batch that is sent twice; the toxic ones are taken down and, after a
    snapshot, restored; under alnum-1 the poor ones come in with the other tokenizer's counts and are revised. In the end the
    totals are those of a plain count over the table. Null texts have no tokens; null languages and sources are groups.
    """
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    folder = _text.shared_dir(spark, "token-rollup")
    docs.select("doc_id", "source", "lang", token_rollup.words_count(F.col("text")).alias("words"), token_rollup.alnum_count(F.col("text")).alias("alnum")).join(marks, "doc_id", "left").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    toxic, poor = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    words, alnum = F.col("words"), F.col("alnum")
    store = token_rollup.Rollup(spark, f"{folder}/store")
    load = token_rollup.inserted(counts, words, "words-1")
    store.commit("load", load)
    store.commit("takedown", token_rollup.deleted(counts.where(toxic), words, "words-1"))
    store.commit("load", load)
    store.compact()
    store.commit("restore", token_rollup.inserted(counts.where(toxic), words, "words-1"))
    store.commit("second", token_rollup.inserted(counts, F.when(poor, words).otherwise(alnum), "alnum-1"))
    store.commit("recount", token_rollup.revised(counts.where(poor), words, alnum, "alnum-1"))
    _text.removed(spark, f"{folder}/counts")
    return store.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of the rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_text.crc_mod(F.col("doc_id"), 3) != 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (_text.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof makes of a copy that half of them have tampered with.

    Tampered rows lose the line breaks of their texts. Null fields are `-`; a null doc_id counts as the empty text where
    tampering is drawn, and comes last in its source; repeated rows are leaves each.
    """
    tampered = _text.crc_mod(F.col("doc_id"), 2) == 0
    found = merkle.manifest(_table(spark, sf_dir, "documents"), changed={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, where=tampered)
    found = found.withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("changed_leaf", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts differ by one at most (law `rows`), equal texts together as far as seats allow.

    Null texts are empty ones; rows without a doc_id and repeated rows take a seat each; slots follow a hash of row and text.
    """
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the client of every sale as known at a time after it, over windows of 2 and 14 days, and whether it buys again.

    Sales without client or time are no probes; null amounts are 0; equal clicks count once, repeated lines each.
    """
    return point_in_time.features(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sales"), _table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": op1_quality_gam,
    "op2_pii": op2_pii,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_rollup": op9_token_rollup,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sharding": op12_sharding,
    "op13_point_in_time": op13_point_in_time,
}

#: crc32 of a short text in SQL: the table of bytes, then a step for each byte.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
)"""


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of a text of ASCII characters; `crc` must stand in FROM."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": rf"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, source, text, replace(text, chr(10), '') AS bare, {_crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS tampered,
         strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, crc
), f AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) END AS changed
  FROM d
), s AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM f
), lower_tree AS (
  SELECT g, 0 AS k, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM s
  UNION ALL
  SELECT g, k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM lower_tree WHERE n > 1 GROUP BY g, k, i // 3
), upper_tree AS (
  SELECT 0 AS k, g - 1 AS i, h, count(*) OVER () AS n FROM lower_tree WHERE n = 1
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM upper_tree WHERE n > 1 GROUP BY k, i // 3
), walk AS (
  SELECT doc_id, g, 0 AS k, i, coalesce(changed, leaf) AS own, '' AS proof FROM s
  UNION ALL
  SELECT w.doc_id, w.g, w.k + 1, w.i // 3, sha256(coalesce(x.l, '') || w.own || coalesce(x.r, '')), w.proof || coalesce(x.l, '') || coalesce(x.r, '')
  FROM walk w JOIN (
    SELECT a.g, a.k, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i) AS l, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i) AS r
    FROM lower_tree a JOIN lower_tree b ON a.g = b.g AND a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.k, a.i
  ) x ON w.g = x.g AND w.k = x.k AND w.i = x.i
), entered AS (
  SELECT w.doc_id, w.g, w.own, w.proof FROM walk w JOIN lower_tree t ON t.g = w.g AND t.k = w.k AND t.i = w.i AND t.n = 1
), climb AS (
  SELECT doc_id, 0 AS k, g - 1 AS i, own, proof FROM entered
  UNION ALL
  SELECT w.doc_id, w.k + 1, w.i // 3, sha256(coalesce(x.l, '') || w.own || coalesce(x.r, '')), w.proof || coalesce(x.l, '') || coalesce(x.r, '')
  FROM climb w JOIN (
    SELECT a.k, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i) AS l, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i) AS r
    FROM upper_tree a JOIN upper_tree b ON a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.k, a.i
  ) x ON w.k = x.k AND w.i = x.i
), top AS (SELECT k, h FROM upper_tree WHERE n = 1)
SELECT s.doc_id, s.leaf, t.h AS subroot, top.h AS root, sha256(c.proof) AS proof_sha256, c.own AS folded_root, c.own = top.h AS verified
FROM s JOIN lower_tree t ON t.g = s.g AND t.n = 1 CROSS JOIN top JOIN climb c ON c.doc_id = s.doc_id AND c.k = top.k""",
    "op13_point_in_time": rf"""
WITH {_CRC_TABLE}, s AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS tm, greatest(epoch_us(sold_at), epoch_us(arrived_at) + 14400000000) AS seen, coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents,
         epoch_us(sold_at) + {_crc("CAST(sale_id AS VARCHAR)")} % 259200 * 1000000 AS t_us
  FROM sales, crc WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), c AS (
  SELECT click_id, client_id, kind, epoch_us(ts) AS tm, greatest(epoch_us(ts), epoch_us(arrived_at) + 14400000000) AS seen, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL
), l AS (
  SELECT s.client_id, s.tm, greatest(s.seen, epoch_us(x.shipped_at)) AS seen, x.item_id, coalesce(CAST(floor(100 * x.amount + 0.5) AS BIGINT), 0) AS cents
  FROM sale_lines x JOIN s ON x.sale_id = s.sale_id WHERE x.shipped_at IS NOT NULL
), p AS (
  SELECT row_number() OVER () AS r, sale_id, client_id, t_us, CAST(d AS INTEGER) AS d, t_us - d * 86400000000 AS since FROM s, (VALUES (2), (14)) AS w(d)
), fc AS (
  SELECT r, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, arg_max(click_id, row(tm, click_id)) AS last_click_id
  FROM p JOIN c ON c.client_id = p.client_id AND c.tm > p.since AND c.seen <= p.t_us GROUP BY r
), fs AS (
  SELECT r, count(*) AS n_sales, sum(cents) AS sale_cents FROM p JOIN s ON s.client_id = p.client_id AND s.tm > p.since AND s.seen <= p.t_us GROUP BY r
), fl AS (
  SELECT r, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(cents) AS line_cents FROM p JOIN l ON l.client_id = p.client_id AND l.tm > p.since AND l.seen <= p.t_us GROUP BY r
), fn AS (
  SELECT DISTINCT r FROM p JOIN s ON s.client_id = p.client_id AND s.tm > p.t_us AND s.tm <= p.t_us + 604800000000
)
SELECT sale_id, d, t_us, fn.r IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents,
       last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items,
       CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM p LEFT JOIN fc USING (r) LEFT JOIN fs USING (r) LEFT JOIN fl USING (r) LEFT JOIN fn USING (r)""",
    "op5_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], chr(10)) AS gram
  FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id
), b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines, len([i for i in range(2, len(ws) + 1) if ws[i] = ws[i - 1]]) AS echoes, length(t) - length(replace(t, '!', '')) AS shouts
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words * 3 OR word_chars < n_words * 2
            OR word_chars > n_words * 15 OR n_dup_lines * 2 > n_lines OR echoes * 10 > n_words * 3 OR shouts * 10 > n_words * 5) AS kept
FROM b""",
    "op9_token_rollup": r"""
WITH c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT source, lang, 'alnum-1', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) FROM documents
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, tokenizer""",
}
