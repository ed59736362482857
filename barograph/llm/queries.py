"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import chat, codes, exact, fingerprints, lm, mixing, neardup, packing, quality, records, substring, topk, trie
from .common import table


def op1_pivot_topk(spark, sf_dir):
    vectors = topk.integral(table(spark, sf_dir, "embeddings"))
    found = topk.topk(vectors, vectors.filter("id % 50 = 0"), k=5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op2_content_defined_dedup(spark, sf_dir):
    return substring.report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_record_files(spark, sf_dir):
    return records.encode_documents(table(spark, sf_dir, "documents"))


def op5_hidden_markov_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op6_simhash_fingerprints(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op7_prefix_target_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(*[F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for n, role in enumerate(("user", "assistant"))])
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")
    return chat.format_and_read(rows.unionByName(own))


def op8_pareto_mixing(spark, sf_dir):
    return mixing.allocation(table(spark, sf_dir, "documents"))


def op9_rule_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_deletion_variant_dedup(spark, sf_dir):
    return neardup.report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return trie.report(table(spark, sf_dir, "conversations"))


def op12_progressive_dedup(spark, sf_dir):
    return exact.report(table(spark, sf_dir, "documents"))


def op13_hamerly_codes(spark, sf_dir):
    return codes.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pivot_topk,
        op2_content_defined_dedup,
        op3_best_fit_packing,
        op4_record_files,
        op5_hidden_markov_lm,
        op6_simhash_fingerprints,
        op7_prefix_target_chat,
        op8_pareto_mixing,
        op9_rule_quality,
        op10_deletion_variant_dedup,
        op11_prefix_trie,
        op12_progressive_dedup,
        op13_hamerly_codes,
    )
}
CONTROLS = "|".join(re.escape(c) for c in chat.CONTROL)
ORACLES: dict[str, str] = {
    "op1_pivot_topk": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_prefix_target_chat": f"""
WITH rows_of AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_of
), sized AS (
  SELECT *, {len(chat.START + chat.SEP + chat.END)} + length(role || text) + length(role || text) - length(replace(role || text, '\\', ''))
         + len(regexp_extract_all(role, '{CONTROLS}')) + len(regexp_extract_all(text, '{CONTROLS}')) AS chars
  FROM turns
), shown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM shown GROUP BY conv_id""",
    "op11_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT DISTINCT c FROM own), crc AS (
  SELECT c, s, CAST(4294967295 AS BIGINT) AS x, 0 AS i FROM (SELECT c, CAST(c AS VARCHAR) AS s FROM convs)
), bits AS (
  SELECT CAST(n AS BIGINT) AS n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) t(n)
), lookup AS (SELECT list(v ORDER BY n) AS t FROM bits), taken AS (
  SELECT c, xor(list_reduce(list_prepend(x, list_transform(string_split(s, ''), lambda z: CAST(ord(z) AS BIGINT))),
                            lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295) % 4 AS h
  FROM crc, lookup
), made AS (
  SELECT taken.c, k AS seq, role, text FROM taken JOIN own b ON b.c = taken.c - taken.c % 20 AND k <= h
  UNION ALL SELECT own.c, k, role, text FROM own JOIN taken USING (c) WHERE k > h
), placed AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY seq) AS d FROM made), path AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS p,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q
  FROM placed UNION ALL SELECT c, 0, 0, '', NULL FROM convs
), nodes AS (
  SELECT d, p, min(CASE WHEN d = 1 THEN '' ELSE q END) AS q, min(c) AS c, count(*) AS n, max(words) AS words FROM path GROUP BY d, p
), lengths AS (SELECT c, max(d) AS d FROM path GROUP BY c), ends AS (
  SELECT d, p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM path JOIN lengths USING (c, d) GROUP BY d, p
), kids AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2), full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, p)
), below AS (
  SELECT path.d, path.p, CAST(sum((n - 1) * u.words) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM full_nodes u JOIN path ON path.c = u.c AND path.d <= u.d GROUP BY 1, 2
)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, parent.c AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes v LEFT JOIN nodes parent ON parent.d = v.d - 1 AND parent.p = v.q
LEFT JOIN below ON below.d = v.d AND below.p = v.p LEFT JOIN ends ON ends.d = v.d AND ends.p = v.p""",
    "op12_progressive_dedup": """
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)""",
}


def _lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Lloyd's rounds one after the other, every distance in full."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""dist{k} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS dist FROM cell x JOIN book{k} b USING (part, k) GROUP BY 1, 2, 3),
code{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, dist * 1000 + entry) AS entry, CAST(min(dist) AS BIGINT) AS dist FROM dist{k} GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, entry, k, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN
  (SELECT part, entry, k, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM code{k} JOIN cell USING (vec_id, part) GROUP BY 1, 2, 3) m USING (part, entry, k))""")
    return f"""
WITH sound AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cell AS MATERIALIZED (
  SELECT vec_id, i // (n // {parts}) AS part, i % (n // {parts}) AS k, v FROM
  (SELECT vec_id, len(v) AS n, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM sound)
), book0 AS MATERIALIZED (
  SELECT part, entry, k, v FROM cell JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM sound ORDER BY vec_id LIMIT {entries}) USING (vec_id)
), {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM code{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, k)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN sound USING (vec_id)"""


ORACLES["op13_hamerly_codes"] = _lloyd_sql()
