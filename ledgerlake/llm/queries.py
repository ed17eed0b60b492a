"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import ann_blocks, bpe, chat, drift_clusters, html_text, line_dedup, minhash, mixing, pii, range_join, repair, topk, toxicity
from ledgerlake.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@_register("op1_line_runs", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.keeper AS dropped FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op1_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_register("op2_ann_blocks", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
""")
def op2_ann_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_blocks.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_register("op3_minhash_stars", """
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS src, a AS dst FROM u UNION SELECT r.src, u.b FROM r JOIN u ON r.dst = u.a),
c AS (SELECT src, min(dst) AS component FROM r GROUP BY src)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.src = d.doc_id
""")
def op3_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@_register("op4_toxicity_channel")
def op4_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@_register("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="surrogate-key-1").select("doc_id", "text", "n_entities")


@_register("op8_chat_snapshots", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM t),
p AS (SELECT *, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h FROM r),
f AS (SELECT conv_id, max(pos) AS n, max_by(h, pos) AS h FROM p GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, h FROM f GROUP BY n, h),
x AS (SELECT DISTINCT p.pos, p.h FROM p JOIN f USING (conv_id) WHERE p.pos < f.n),
m AS (SELECT w.* FROM w ANTI JOIN x ON x.pos = w.n AND x.h = w.h)
SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 256) - 1 AS INTEGER) AS part, n AS n_turns, n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM r JOIN m USING (conv_id) GROUP BY conv_id, turn // 256, n, n_copies
""")
def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


@_register("op7_tag_paths")
def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_register("op9_threshold_topk", """
WITH v AS (SELECT vec_id, max(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
""")
def op9_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_register("op6_bpe_prefix")
def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


@_register("op10_temperature_mix", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
                            ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents),
t AS (SELECT sum(n_words) AS total FROM d),
s AS (SELECT source, sum(n_words)::BIGINT AS tokens, sum(n_words) / (SELECT total FROM t)::DOUBLE AS share FROM d GROUP BY source HAVING sum(n_words) > 0),
l AS (SELECT list(share) AS p, count(*) AS n FROM s),
hi AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS up UNION ALL
       SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN up ELSE mid END FROM (
         SELECT i, lo, up, (lo + up) / 2 AS mid,
                ln(list_sum(list_transform(p, lambda x: pow(x, (lo + up) / 2)))) - list_sum(list_transform(p, lambda x: pow(x, (lo + up) / 2) * (lo + up) / 2 * ln(x)))
                  / list_sum(list_transform(p, lambda x: pow(x, (lo + up) / 2))) >= 0.98 * ln(n::DOUBLE) - 1e-12 AS ok
         FROM hi, l WHERE i < 48)),
ra AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS up UNION ALL
       SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE up END FROM (
         SELECT i, lo, up, (lo + up) / 2 AS mid,
                list_max(list_transform(p, lambda x: pow(x, (lo + up) / 2) / x)) / list_sum(list_transform(p, lambda x: pow(x, (lo + up) / 2))) <= 4.0 + 1e-12 AS ok
         FROM ra, l WHERE i < 48)),
a AS (SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(
        CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.98 * ln(n::DOUBLE) - 1e-12 THEN 1.0 ELSE (SELECT max(lo) FROM hi WHERE i = 48) END,
        CASE WHEN list_max(list_transform(p, lambda x: 1 / x)) / n <= 4.0 + 1e-12 THEN 0.0 ELSE (SELECT max(up) FROM ra WHERE i = 48) END) END AS a FROM l),
w AS (SELECT source, tokens, pow(share, (SELECT a FROM a)) / (SELECT sum(pow(share, (SELECT a FROM a))) FROM s) AS weight FROM s),
b AS (SELECT source, tokens, weight, floor(round(weight * (SELECT total FROM t)::DOUBLE, 3))::BIGINT AS budget FROM w),
c AS (SELECT d.*, b.weight, b.tokens, b.budget, sum(n_words) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, n_words, coalesce(weight, 0.0) AS weight,
       coalesce(budget // tokens + CASE WHEN upto <= budget % tokens THEN 1 ELSE 0 END, 0)::BIGINT AS n_copies FROM c
""")
def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "n_words", "weight", "n_copies")


def _repair_sql() -> str:
    """The repair as SQL: a recursion over turns from the last to the first with the best (cost, audit, lines) by state."""
    need, to = "uuau", (2, 2, 3, 2)

    def option(cost: str, audit: str, lines: str) -> str:
        return f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 't': {lines}}}"

    def edits(s: int) -> str:
        n, role = to[s], "assistant" if need[s] == "a" else "user"
        found = [option(f"f{s}.c + 2", f"'D' || f{s}.a", f"f{s}.t"),
                 f"CASE WHEN NOT must THEN {option(f'f{n}.c + 1 + extra', f"'R' || f{n}.a", f"list_prepend('{role}:' || text, f{n}.t)")} END",
                 f"CASE WHEN NOT must AND initial = '{need[s]}' THEN {option(f'f{n}.c + extra', f"'K' || f{n}.a", f"list_prepend(role || ':' || text, f{n}.t)")} END"]
        if s == 0:
            found.append(f"CASE WHEN NOT must AND initial = 's' THEN {option('f1.c + extra', "'K' || f1.a", "list_prepend(role || ':' || text, f1.t)")} END")
        return f"least({', '.join(found)}) AS b{s}"

    def insert(s: int, value: str) -> str:
        role = "assistant" if need[s] == "a" else "user"
        return option(f"{value}.c + 5", f"'I' || {value}.a", f"list_prepend('{role}:', {value}.t)")

    end = [option("0", "''", "[]::VARCHAR[]"), option("10", "'II'", "['user:', 'assistant:']"), option("5", "'I'", "['assistant:']"), option("0", "''", "[]::VARCHAR[]")]
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
c0 AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS codes FROM conversations),
c1 AS (SELECT * EXCLUDE (codes), xor(list_reduce(codes, lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS hit FROM c0, tab),
c2 AS (SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
              CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
       FROM c1 WHERE hit <> 0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM c2),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
              CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM r0),
r2 AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS cut,
              lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair, row_number() OVER (PARTITION BY conv ORDER BY pos DESC) AS back FROM r1),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r2 GROUP BY conv),
dp AS (
  SELECT conv, 0::BIGINT AS k, {', '.join(f'{e} AS f{i}' for i, e in enumerate(end))} FROM n
  UNION ALL
  SELECT conv, k, least(b0, {insert(0, 'v2')}) AS f0, least(b1, {insert(1, 'v2')}) AS f1, v2 AS f2, v3 AS f3 FROM (
    SELECT *, least(b2, {insert(2, 'b3')}) AS v2, least(b3, {insert(3, 'b2')}) AS v3 FROM (
      SELECT conv, k, {', '.join(edits(s) for s in range(4))} FROM (
        SELECT dp.conv, dp.k + 1 AS k, f0, f1, f2, f3, r.role, r.text, r.initial, r.blank OR r.duplicate AS must, CASE WHEN r.cut THEN 5 ELSE 0 END AS extra
        FROM dp JOIN r2 r ON r.conv = dp.conv AND r.back = dp.k + 1)))),
best AS (SELECT n.*, f0.c AS cost, f0.a AS audit, f0.t AS lines FROM n JOIN dp ON dp.conv = n.conv AND dp.k = n.n),
ids AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN best USING (conv)"""


@_register("op11_suffix_repair", _repair_sql())
def op11_suffix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def _cluster_sql(rounds: int = 5) -> str:
    """Lloyd's rounds written out one after the other, all distances computed."""
    floored = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    steps = ["""
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < 40)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(v, m), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), 'c': c}}) AS b
  FROM v, c{i} GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""
x{i} AS (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}),
m{i} AS (SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, {floored} AS f FROM x{i} GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m{i}.m, c.m) AS m FROM c{i} c LEFT JOIN m{i} USING (c))""")
    return f"""
WITH {','.join(steps)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.c = b.c"""


@_register("op12_drift_clusters", _cluster_sql())
def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_clusters.cluster(read(spark, sf_dir, "embeddings"))


@_register("op13_range_join", """
WITH RECURSIVE v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
                   vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, max(CASE WHEN fine THEN {'p': len(v) || ':' || label, 'v': v} END) AS w FROM v0 GROUP BY vec_id),
u AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.w.p = b.w.p AND a.vec_id <> b.vec_id
                   WHERE list_dot_product(a.w.v, b.w.v) / (sqrt(list_dot_product(a.w.v, a.w.v)) * sqrt(list_dot_product(b.w.v, b.w.v))) >= 0.93),
r AS (SELECT DISTINCT a AS src, a AS dst FROM u UNION SELECT r.src, u.b FROM r JOIN u ON r.dst = u.a),
c AS (SELECT src, min(dst) AS component FROM r GROUP BY src),
l AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, coalesce(l.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, coalesce(coalesce(c.component, vec_id) = vec_id, true) AS kept
FROM v LEFT JOIN c ON c.src = vec_id LEFT JOIN l ON l.a = vec_id
""")
def op13_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(read(spark, sf_dir, "embeddings"))
