"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm import toxicity
    from floodspark.llm.lm_score import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=4, remainder=2)
    out = toxicity.score(docs, machine).withColumnRenamed("toxicity", "score")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.substring_dedup import repeated_words

    out = repeated_words(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 12) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS p FROM win JOIN least USING (g) WHERE m < doc_id),
left_over AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) k
  ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.decontaminate import matches

    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM p),
win AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes)),
hits AS (SELECT doc_id, s, n, item_id FROM win JOIN p USING (g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS k FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.token_files import written_and_read

    return written_and_read(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP5_SQL = """
WITH e AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: CAST(x AS DOUBLE) / n) AS w FROM e WHERE isfinite(n) AND n > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.w, b.w) >= 0.95e0),
reach AS (WITH RECURSIVE r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.id) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, r.c AS component_id, r.c = e.vec_id AS kept
FROM e JOIN reach r ON r.id = e.vec_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return out.select("doc_id", "fingerprint", "component_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm import language_id
    from floodspark.llm.lm_score import held_out

    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"), modulus=3, remainder=1)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.suffix_dedup import repeated_bytes

    out = repeated_bytes(table(spark, sf_dir, "documents"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def crc32_sql(x: str) -> str:
    """crc32 of a decimal number in DuckDB, which has no such function."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
          lambda crc, y: list_reduce(list_prepend(xor(crc, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm import common, conversation_trie

    turns = common.stored(conversation_trie.ordered(table(spark, sf_dir, "conversations")))
    ids = common.stored(turns.select("conv_id").distinct())
    nodes, ends = conversation_trie.trie(common.stored(conversation_trie.branched(turns, ids)), ids)
    out = nodes.join(conversation_trie.end_digests(ends), ["depth", "key"], "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


OP11_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
own AS (SELECT i.conv_id, o.p, role, text FROM ids i JOIN o ON o.conv_id = i.base AND o.p < i.h UNION ALL SELECT i.conv_id, 100 + o.p, role, text FROM ids i JOIN o ON o.conv_id = i.conv_id AND o.p >= i.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, role, text FROM own),
whole AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY depth) AS w FROM r GROUP BY conv_id),
way AS (SELECT conv_id, 0 AS depth, [] :: STRUCT(role VARCHAR, text VARCHAR)[] AS k, 0 AS b FROM ids UNION ALL SELECT conv_id, depth, list_slice(w, 1, depth), strlen(text) FROM r JOIN whole USING (conv_id)),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b FROM way GROUP BY depth, k),
met AS (SELECT w.conv_id AS member, w.depth, n.conv_id FROM way w JOIN n ON w.depth = n.depth AND w.k = n.k),
up AS (SELECT n.*, a.conv_id AS parent_conv_id FROM n LEFT JOIN met a ON a.member = n.conv_id AND a.depth = n.depth - 1),
ch AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN ch USING (conv_id, depth)),
sub AS (SELECT a.conv_id, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.b) AS saved FROM f JOIN met a ON a.member = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2),
last AS (SELECT i.conv_id AS member, max(w.depth) AS depth FROM ids i JOIN way w USING (conv_id) GROUP BY 1),
e AS (SELECT a.conv_id, a.depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS ends FROM last JOIN met a USING (member, depth) GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN sub USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.posting_lists import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 100 == 0), vectors, top=10)


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_prepend(0e0, list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i]))), lambda a, b: a + b)) AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM d WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodspark.llm.merkle import proofs

    out = proofs(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = f"""
WITH RECURSIVE
b AS (SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END AS i,
        CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS sl,
        n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t,
        {crc32_sql("doc_id")} % 7 = 0 AS hit
      FROM documents),
l AS (SELECT doc_id, lang, sha256(i || sl || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || t) AS leaf,
        sha256(i || sl || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + CAST(coalesce(hit, false) AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(hit, false) AS BIGINT)) END || t) AS other FROM b),
r AS (SELECT *, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM l),
lev AS (SELECT tree, 0 AS k, list(leaf ORDER BY p) AS h FROM r GROUP BY tree
        UNION ALL SELECT tree, k + 1, list_transform(range(0, (len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM lev WHERE len(h) > 1),
sub AS (SELECT tree, h[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS q FROM lev WHERE len(h) = 1),
up AS (SELECT 0 AS k, list(subroot ORDER BY q) AS h FROM sub
       UNION ALL SELECT k + 1, list_transform(range(0, (len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM up WHERE len(h) > 1),
step AS (SELECT r.doc_id, r.leaf, r.tree, r.p, k, CAST(r.p >> CAST(k AS INT) AS BIGINT) AS pl, h FROM r JOIN lev USING (tree) WHERE len(h) > 1
         UNION ALL SELECT r.doc_id, r.leaf, r.tree, r.p, 1000 + up.k, CAST(q >> CAST(up.k AS INT) AS BIGINT), h FROM r JOIN sub USING (tree), up WHERE len(h) > 1),
way AS (SELECT tree, p, list(CASE WHEN pl % 2 = 1 THEN 'L' || h[pl] ELSE 'R' || coalesce(h[pl + 2], '') END ORDER BY k) AS w FROM step GROUP BY tree, p),
f AS (SELECT r.*, coalesce(w, []) AS w, list_reduce(list_prepend(other, coalesce(w, [])), lambda a, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM r LEFT JOIN way USING (tree, p))
SELECT doc_id, leaf, subroot, (SELECT h[1] FROM up WHERE len(h) = 1) AS root, sha256(coalesce(array_to_string(list_transform(w, lambda x: x[2:]), ''), '')) AS proof_sha256, folded_root,
  folded_root = (SELECT h[1] FROM up WHERE len(h) = 1) AS verified
FROM f JOIN sub USING (tree)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op12_nearest": OP12_SQL, "op13_merkle": OP13_SQL}
