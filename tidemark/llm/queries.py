"""The registered queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitslice, decontaminate, langid, orc_tokens, pii, prefix_trie, sharding, simhash, spiece, substring_dedup, suffix_dedup, toxicity, variants
from tidemark.llm.common import scratch, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out("doc_id"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = spiece.decode(spiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return found.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.expr("decoded = coalesce(text, '')").alias("round_trip"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return orc_tokens.summary(spark, path)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), scratch(spark, "slots"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.counted(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.runs(table(spark, sf_dir, "conversations"))))
    found = prefix_trie.with_parents(nodes).join(prefix_trie.ends_sha256(ends), "node", "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_language_id, op3_sentencepiece, op4_token_orc, op5_suffix_dedup, op6_sharding, op7_decontamination, op8_pii_surrogates, op9_substring_dedup, op10_bit_sliced_topk, op11_toxicity, op12_spelling_variants, op13_prefix_trie)}


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS j FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, j, md5(array_to_string(w[j:j + 34], ' ')) AS k FROM i),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT h.doc_id AS doc_id, h.j + t.o AS p FROM h JOIN r ON h.k = r.k JOIN range(0, 35) t(o) ON TRUE),
g AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id AS doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p WHERE c.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


OP12_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS n FROM runs GROUP BY doc_id, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM each),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spots AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v),
gone AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM spots),
near AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gone a JOIN v ON a.d = v.word UNION SELECT v.word, a.word, a.n FROM gone a JOIN v ON a.d = v.word),
best AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, min(ROW(-near_n, near)) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT v.word AS word, v.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * v.n THEN CAST(-b[1] AS BIGINT) END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS last_word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.last_word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word AS word, w.last_word AS root FROM walk w JOIN formed f ON f.word = w.last_word WHERE f.form IS NULL)
SELECT f.word AS word, form, root, n, n_near, form_n FROM formed f JOIN ends ON ends.word = f.word
"""


OP13_SQL = """
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), tab),
parts AS (SELECT c.conv_id AS conv_id, 0 AS section, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND p > h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(md5(length(role) || ' ' || role || text), '') OVER w AS path FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY section, p ROWS UNBOUNDED PRECEDING)),
members AS MATERIALIZED (SELECT conv_id, depth, chars, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (SELECT path, max(depth) AS depth, max(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY path),
last AS (SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT left(n.path, 32 * i) AS path, (n_convs - 1) * chars AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM nodes) n LEFT JOIN kids ON kids.path = n.path),
sums AS (SELECT path, sum(saved) AS saved, sum(leaf) AS leaves FROM up GROUP BY path)
SELECT n.conv_id AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums ON sums.path = n.path LEFT JOIN kids ON kids.path = n.path LEFT JOIN ends ON ends.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: hashes, tokenizers, learned centroids, greedy dealing, edit distances."""
    return {"op9_substring_dedup": OP9_SQL, "op10_bit_sliced_topk": OP10_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL}
