"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondeflow.llm import crf, ctw, descent, gam, lloyd, mixing, neardup, packing, pii, pivots, spelling, substrings, wordpiece
from sondeflow.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_pieces(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = crf.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"), k=16, dim=64, scale=64.0, rounds=3)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_nearest_neighbours, op3_substring_dedup, op4_quality, op5_pii, op6_token_counts, op7_toxicity, op8_top_products, op9_near_duplicates, op10_packing, op11_clusters, op12_spelling_variants, op13_context_tree)}


_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.a, r.root FROM r JOIN links l ON l.b = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


def _lloyd_sql(k: int, dim: int, scale: int, rounds: int) -> str:
    """Lloyd's rounds one after another: a{i} assigns the vectors to the centroids c{i}."""
    start = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""
    squares = "list_sum(list_transform(list_zip(v.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        start += f""",
a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, v.v, c.c, c.m, CAST({squares} AS BIGINT) AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)"""
        if i < rounds:
            start += f""",
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)"""
    return f"""{start}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds}"""


_OP12 = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
coded AS (SELECT run, k, list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST(strpos('0123456789ABCDEF', x[i]) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 17 AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295) AS c FROM each, t),
hashed AS (SELECT run, k, xor(c, 4294967295) AS h FROM coded),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM w)),
shorter AS (SELECT DISTINCT cut.word AS a, w.word AS b FROM cut JOIN w ON w.word = cut.a || cut.b),
near AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
best AS (SELECT a, count(*) AS n_near, min({'minus': -w.n, 'form': w.word}) AS f FROM near JOIN w ON w.word = near.b GROUP BY a),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.minus >= 2 * w.n THEN f.form END AS form, CASE WHEN -f.minus >= 2 * w.n THEN -f.minus END AS form_n FROM w LEFT JOIN best ON best.a = w.word),
way(word, tip, next) AS (SELECT word, word, form FROM told UNION ALL SELECT way.word, told.word, told.form FROM way JOIN told ON told.word = way.next)
SELECT told.word, told.form, way.tip AS root, told.n, told.n_near, told.form_n FROM told JOIN way ON way.word = told.word AND way.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op8_top_products": _OP8, "op9_near_duplicates": _OP9, "op11_clusters": _lloyd_sql(k=16, dim=64, scale=64, rounds=3), "op12_spelling_variants": _OP12}
