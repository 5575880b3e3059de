"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import alignment, chat, collocations, decontam, langid, lines, media, mixing, pii, simhash, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    shards = F.transform("draws", lambda d: d["shard"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *pii.counts(F.col("base")),
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate(_table(spark, sf_dir, "conversations"))
    marks = F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return turned.withColumn("masks", F.array_join(marks, ","))


OP4_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn,
    replace(replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), '<|', '<\|'), '"', '\"'), chr(10), '\n'), chr(13), '\r') AS role,
    replace(coalesce(text, ''), '<|', '<\|') AS text
  FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), p AS (
  SELECT t.conv_id, perspective, turn, role, text, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
         WHEN role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name="' || role || '"|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text) AS upto
  FROM p
)
SELECT conv_id, perspective, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR) END, ','
    ORDER BY turn NULLS LAST, role, text), '') AS masks
FROM o GROUP BY conv_id, perspective
"""


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM bi, unnest(range(1, len(w) - n + 2)) AS t(i)
), dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(i)
), m AS (
  SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m), unnest(range(i, i + n)) AS t(p) GROUP BY r
), q AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN q USING (r)
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens.token_counts(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join("gone", ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align(docs, a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30
), x AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL
), o AS (
  SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), u AS (
  SELECT o.lang, o.phrase, o.a, l.f AS l, r.f AS r,
    CAST((2000000 * CAST(o.a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY o.lang, o.phrase ORDER BY (2000000 * CAST(o.a AS HUGEINT)) // (l.f + r.f), m) AS first
  FROM o, unnest(range(1, o.k)) AS s(m)
  JOIN g l ON l.lang = o.lang AND l.phrase = array_to_string(o.w[1 : m], ' ')
  JOIN g r ON r.lang = o.lang AND r.phrase = array_to_string(o.w[m + 1 :], ' ')
), k AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM u WHERE first = 1
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, _table(spark, sf_dir, "pages"))


OP13_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_media, op3_pii, op4_chat, op5_decontam, op6_langid, op7_simhash, op8_tokens, op9_lines, op10_toxicity, op11_alignment, op12_collocations, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op5_decontam": OP5_SQL, "op12_collocations": OP12_SQL, "op13_warc": OP13_SQL}
