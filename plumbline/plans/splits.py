"""Keyed order, splits, draws and picks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import global_rank, hash_order
from ..operators import splits as S
from ..operators.clusters import cluster_split
from ..operators.similarity import similarity_split
from ..operators.gates import coverage
from ..operators.metrics import drawn_positions

FRACTIONS, SEED = (0.7, 0.2, 0.1), 11
CAP, SIZES, SEEDS = 256, (32, 128), (0, 1)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variants: status the assay, customer the position, price the score."""
    o = _t(spark, sf_dir, "orders")
    fold = lambda c: F.pmod(c, F.lit(5)).cast("int")
    return o.select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", fold(F.col("o_orderkey") * 7 + 3).alias("fold_random"), fold(F.col("o_custkey")).alias("fold_modulo"), fold(F.floor(F.col("o_custkey") / 10)).alias("fold_contiguous"))


SCHEMES = ["fold_random", "fold_modulo", "fold_contiguous"]


def x1_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(_t(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "rank")


def x2_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", hash_order(7, F.col("doc_id")).alias("h"))


def p1_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", S.hash_split(F.col("user_id"), FRACTIONS, SEED).alias("role"))


def p1_balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced_split(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", FRACTIONS, SEED, large=0.05)


def p1_balanced_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = S.balanced_split(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", (0.6, 0.4, 0.0), SEED)
    return S.split_sizes(split)


def p2_inherited_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = S.inherited_split(_t(spark, sf_dir, "events"), F.pmod("user_id", F.lit(10)) == 0, F.col("user_id"), (0.85, 0.15, 0.0), SEED)
    return split.select("event_id", "role")


def p3_fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_roles(_folds(spark, sf_dir), SCHEMES).groupBy("o_orderstatus", "scheme", "role").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def p4_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = S.fold_roles(_folds(spark, sf_dir), SCHEMES).where("role = 'val'")
    return S.capped(val, ["o_orderstatus", "scheme"], "o_orderkey", CAP).select("o_orderkey", "scheme")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = S.fold_roles(_folds(spark, sf_dir), SCHEMES).where("role = 'pool'")
    return S.draws(pool, ["o_orderstatus", "scheme"], "o_orderkey", SIZES, SEEDS)


def p5_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir).select("o_orderkey", "scheme", "n", "seed")


def a17_drawn_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_positions(_drawn(spark, sf_dir), ["o_orderstatus", "scheme", "n", "seed"], "o_custkey")


def p6_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _t(spark, sf_dir, "orders").select("o_custkey", S.hash_split(F.col("o_orderkey"), FRACTIONS, SEED).alias("role"))
    return S.leak_audit(split, "o_custkey")


def p6_no_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _t(spark, sf_dir, "orders").select("o_custkey", S.hash_split(F.col("o_custkey"), FRACTIONS, SEED).alias("role"))
    return S.leaks(split.where("role = 'train'"), split.where("role = 'test'"), "o_custkey").agg(F.count("*").alias("n_shared"))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_sizes(p1_hash_split(spark, sf_dir))


def j5_shuffled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffled_pairs(_t(spark, sf_dir, "documents"), "doc_id", "n_chars", 3)


def j7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return coverage(customers, _t(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("k")), "k")


def w2_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_sample(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100, 5)


def w3_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evenly_spaced(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 17)


def z3_cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose keys follow each other are linked where the first has money; four in a row at most."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    links = c.where((F.pmod("c_custkey", F.lit(4)) > 0) & (F.col("c_acctbal") > 0)).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    links = links.join(c.select(F.col("c_custkey").alias("b")), "b", "left_semi").select("a", "b")
    return cluster_split(c, "c_custkey", links, FRACTIONS, SEED).select("c_custkey", "cluster", "role")


def z4_similarity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share four fifths of their runs of five words, over any number of links, are in one role."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").alias("text"))
    return similarity_split(docs, "doc_id", "text", FRACTIONS, SEED, words=True).select("doc_id", "cluster", "role")


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT / 4503599627370496.0)"


def _role(u: str, f=FRACTIONS) -> str:
    return f"CASE WHEN {u} < {f[0]} THEN 'train' WHEN {u} < {f[0] + f[1]} THEN 'val' ELSE 'test' END"


_LONG = """
WITH f AS (SELECT *, ((o_orderkey * 7 + 3) % 5)::INT AS fold_random, (o_custkey % 5)::INT AS fold_modulo, ((o_custkey // 10) % 5)::INT AS fold_contiguous FROM orders),
l AS (SELECT o_orderkey, o_orderstatus, o_custkey, scheme, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'pool' END AS role FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus, o_custkey, fold_random, fold_modulo, fold_contiguous FROM f) ON fold_random, fold_modulo, fold_contiguous INTO NAME scheme VALUE fold)),
d AS (SELECT * FROM (SELECT l.*, n, seed, row_number() OVER (PARTITION BY o_orderstatus, scheme, n, seed ORDER BY md5(o_orderstatus || ':' || scheme || ':' || n || ':' || seed || ':' || o_orderkey), o_orderkey) AS k
  FROM l, (VALUES (32), (128)) a(n), (VALUES (0), (1)) b(seed) WHERE role = 'pool') WHERE k <= n)
"""

QUERIES = {f.__name__: f for f in (x1_global_rank, x2_hash_order, p1_hash_split, p1_balanced_split, p1_balanced_large, p2_inherited_split, p3_fold_roles, p4_capped, p5_draws, a17_drawn_positions, p6_leak_audit, p6_no_leak, p6_sizes, j5_shuffled_pairs, j7_coverage, w2_stratified, w3_evenly_spaced, z3_cluster_split, z4_similarity_split)}
SQL = {
    "x1_global_rank": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rank FROM events",
    "x2_hash_order": "SELECT doc_id, md5('7:' || doc_id) AS h FROM documents",
    "p1_hash_split": f"SELECT event_id, {_role(_u(repr(str(SEED)), 'user_id'))} AS role FROM events",
    "p1_balanced_split": f"""WITH g AS (SELECT o_custkey, count(*) AS size, md5('{SEED}:' || o_custkey) AS h FROM orders GROUP BY o_custkey),
      m AS (SELECT o_custkey, coalesce(sum(size) OVER (ORDER BY h, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle FROM g), t AS (SELECT count(*) AS n FROM orders)
      SELECT o_orderkey, o_custkey, CASE WHEN middle < {FRACTIONS[0]} * n THEN 'train' WHEN middle < {FRACTIONS[0] + FRACTIONS[1]} * n THEN 'val' ELSE 'test' END AS role FROM orders JOIN m USING (o_custkey), t""",
    "p2_inherited_split": f"SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'test' ELSE {_role(_u(repr(str(SEED)), 'user_id'), (0.85, 0.15))} END AS role FROM events",
    "p3_fold_roles": _LONG + "SELECT o_orderstatus, scheme, role, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM l GROUP BY ALL",
    "p4_capped": _LONG + f"SELECT o_orderkey, scheme FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, scheme ORDER BY md5('validation:' || o_orderstatus || ':' || scheme || ':' || o_orderkey), o_orderkey) AS k FROM l WHERE role = 'val') WHERE k <= {CAP}",
    "p5_draws": _LONG + "SELECT o_orderkey, scheme, n, seed FROM d",
    "a17_drawn_positions": _LONG + "SELECT o_orderstatus, scheme, n, seed, count(DISTINCT o_custkey) AS train_positions, count(*) AS n_train FROM d GROUP BY ALL",
    "p6_leak_audit": f"WITH s AS (SELECT DISTINCT o_custkey, {_role(_u(repr(str(SEED)), 'o_orderkey'))} AS role FROM orders) SELECT a.role AS role_a, b.role AS role_b, count(*) AS n FROM s a JOIN s b USING (o_custkey) WHERE a.role < b.role GROUP BY ALL",
    "p6_no_leak": f"WITH s AS (SELECT DISTINCT o_custkey, {_role(_u(repr(str(SEED)), 'o_custkey'))} AS role FROM orders) SELECT count(*) AS n_shared FROM s a JOIN s b USING (o_custkey) WHERE a.role = 'train' AND b.role = 'test'",
    "p1_balanced_large": f"""WITH RECURSIVE g AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY md5('{SEED}:' || source), source) AS i FROM documents GROUP BY source),
      t(i, source, size, role, a, b) AS (SELECT 0, '', 0, '', 0.6::DOUBLE * count(*), 0.4::DOUBLE * count(*) FROM documents UNION ALL
        SELECT g.i, g.source, g.size, CASE WHEN a >= b THEN 'train' ELSE 'val' END, CASE WHEN a >= b THEN a - g.size ELSE a END, CASE WHEN a >= b THEN b ELSE b - g.size END FROM t JOIN g ON g.i = t.i + 1)
      SELECT role, sum(size)::BIGINT AS n FROM t WHERE i > 0 GROUP BY role""",
    "p6_sizes": f"SELECT {_role(_u(repr(str(SEED)), 'user_id'))} AS role, count(*) AS n FROM events GROUP BY ALL",
    "j5_shuffled_pairs": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), b AS (SELECT doc_id AS other, n_chars, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, other, n_chars FROM a JOIN b USING (r)",
    "j7_coverage": "WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey + 5 AS k FROM orders) SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'foreign' FROM b WHERE k NOT IN (SELECT k FROM a)",
    "w2_stratified": """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER () AS n, md5('5:' || doc_id) AS h FROM documents),
      s AS (SELECT *, (k * 10 // n)::INT AS stratum FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS i, count(*) OVER (PARTITION BY stratum) AS c FROM s)
      SELECT stratum, doc_id, n_chars FROM o ORDER BY CASE WHEN i <= round(100.0::DOUBLE * c / n) THEN 0 ELSE 1 END, h, doc_id LIMIT 100""",
    "z3_cluster_split": f"""WITH c AS (SELECT c_custkey AS k, lag(c_custkey) OVER (ORDER BY c_custkey) = c_custkey - 1 AND (c_custkey - 1) % 4 > 0 AND lag(c_acctbal) OVER (ORDER BY c_custkey) > 0 AS linked FROM customer),
      r AS (SELECT k, max(CASE WHEN coalesce(linked, false) THEN NULL ELSE k END) OVER (ORDER BY k) AS cluster FROM c) SELECT k AS c_custkey, cluster, {_role(_u(repr(str(SEED)), 'cluster'))} AS role FROM r""",
    "z4_similarity_split": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+'), lambda x: x <> '') AS ws FROM documents),
      g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
      l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
      k AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS cluster FROM documents d LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id) SELECT doc_id, cluster, {_role(_u(repr(str(SEED)), 'cluster'))} AS role FROM k""",
    "w3_evenly_spaced": "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars, rank FROM r WHERE rank IN (SELECT round_even(i * (n - 1) / 16, 0)::BIGINT FROM range(17) t(i), (SELECT count(*) AS n FROM documents))",
}
