"""The registered queries of the language-model operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, exact_dedup, licenses, mixing, ngram_lm, packing, pii, prefix_trie, quality, simhash, spelling, substring_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as three batches by a hash of the id: the first two are the snapshots of the later ones."""
    docs = documents(spark, sf_dir)
    found = exact_dedup.exact_groups(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    return found.withColumnRenamed("digest", "text_sha256")


ORACLE["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))[0].drop("source", "tie")


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(documents(spark, sf_dir), ngram_lm.crc_remainder(F.col("doc_id"), 5) == 1)


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = ngram_lm.crc_remainder(F.col("doc_id"), 4) == 2
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), model).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_products(vectors, F.pmod("vec_id", F.lit(50)) == 0).drop("evaluated")


ORACLE["op3_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), met AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM met)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["number"] < len(pii.BASE_KINDS))
    return found.select(
        "doc_id", *[pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
    )


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


ORACLE["op8_suffix_array_dedup"] = """
WITH d AS (
    SELECT doc_id, encode(coalesce(text, '')) AS raw, lower(hex(encode(coalesce(text, '')))) AS digits, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, i, substr(digits, 2 * i + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS t(i)
), least_id AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
gone AS (SELECT doc_id, i FROM w JOIN least_id USING (s) WHERE m < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM gone),
islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, run),
parts AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
    UNION ALL SELECT d.doc_id, n, n, coalesce((SELECT max(b) FROM spans s WHERE s.doc_id = d.doc_id), 0) FROM d
), kept AS (
    SELECT p.doc_id, string_agg(substr(digits, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS digits, CAST(sum(b - a) AS BIGINT) AS n_removed,
           count(*) - 1 AS n_spans FROM parts p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept.digits)) AS kept_sha256 FROM kept JOIN d USING (doc_id)
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


#: CRC-32 of a list of byte values, bit by bit.
CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes}), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""

ORACLE["op11_spelling_variants"] = """
WITH RECURSIVE seen AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM documents, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS u(r) GROUP BY 1, 2
), hashed AS (
    SELECT run, n, {crc} AS h
    FROM seen WHERE length(run) >= 7
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS p(i)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
    UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), led AS (
    SELECT word, form AS root, 1 AS steps FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT l.word, f.form, steps + 1 FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NOT NULL
)
SELECT word, form, coalesce((SELECT arg_max(root, steps) FROM led WHERE led.word = formed.word), word) AS root, n, n_near, form_n FROM formed
""".replace("{crc}", CRC32.replace("{bytes}", """flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"""))


@query
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a chain of replies, beside one whose texts look like the template's own marks."""
    odd = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.conversations(chat.chain(turns), "conv_id"))


ORACLE["op12_chat_formatting"] = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt,
           CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '###|</turn>'))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE["op13_conversation_trie"] = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nth
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), turned AS (
    SELECT c.conv_id, 0 AS part, nth, role, text FROM c JOIN t ON t.conv_id = base AND nth < h
    UNION ALL SELECT c.conv_id, 1, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND nth >= h
), numbered AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, nth) AS depth,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, sha256(length(role) || ':' || role || text) AS digest FROM turned
), prefixes AS (
    SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM numbered
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), ended AS (
    SELECT conv_id, max(depth) AS depth, max(node) AS node FROM prefixes GROUP BY conv_id
), nodes AS (
    SELECT node, depth, max(words) AS words, count(*) AS n_convs, min(conv_id) AS least FROM prefixes GROUP BY node, depth
), kids AS (
    SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), under AS (
    SELECT left(d.node, 64 * up) AS node, (n_convs - 1) * words AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes d LEFT JOIN kids k USING (node), unnest(range(0, d.depth + 1)) AS u(up)
), summed AS (SELECT node, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM under GROUP BY node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM ended GROUP BY node)
SELECT n.least AS conv_id, n.depth, p.least AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN summed s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN ends e USING (node)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, 64 * (n.depth - 1))
""".replace("{crc}", CRC32.replace("{bytes}", "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: unicode(c)::BIGINT)"))
