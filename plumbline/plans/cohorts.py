"""Cohort preparation, joins, profiles and readers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import new_folder as _folder
from ..operators import gates as G
from ..operators import prep as P
from ..sources import readers, sinks
from .splits import SCHEMES, _folds, _t


def s1_labelled_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "fasta")
    body = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "(.{60})", "$1\n")
    label = F.element_at(F.array(*map(F.lit, readers.LABELS)), (F.pmod("doc_id", F.lit(10)) + 1).cast("int"))
    header = F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit(" "), label, F.lit("-"), F.element_at(F.array(*map(F.lit, readers.SOLUBILITY)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.when(F.pmod("doc_id", F.lit(4)) == 0, " test").otherwise(""))
    _t(spark, sf_dir, "documents").select(F.concat_ws("\n", header, body)).write.text(path)
    return readers.read_labelled_fasta(spark, path)[0]


def s3_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names = _folder(spark, "annotations"), list(readers.ANNOTATION_NAMES)
    plain = lambda c: F.regexp_replace(c, r"[\t\n\r]", " ")
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias(names[0]), plain(F.concat(F.lit('"'), F.col("text"))).alias(names[1]), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang")).alias(names[2]), F.lit(None).cast("string").alias(names[3]), F.col("source").alias(names[4]), F.col("lang").alias(names[5]))
    rows.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_annotations(spark, path).select("entry_accession", F.length("function_text").alias("n_function"), "go_component", "go_process", "go_function", "keywords")


def s4_assay_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assays: a file with the columns of the reference in another order, one more, and empty cells."""
    path = _folder(spark, "reference")
    part = _t(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_brand").alias("note"), F.col("p_retailprice").cast("int").alias("DMS_number_single_mutants"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("DMS_id"), F.when(F.pmod("p_partkey", F.lit(9)) > 0, F.col("p_type")).alias("taxon"),
        F.col("p_name").alias("target_seq"), F.length("p_name").alias("seq_len"), (F.pmod("p_size", F.lit(3)) == 0).alias("includes_multiple_mutants"),
    )
    rows.write.csv(path, header=True)
    return readers.read_assay_reference(spark, path).withColumn("taxon", F.coalesce("taxon", F.lit("")))


def s10_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three named result tables two exist, with columns of their own: orders by status and by priority."""
    folder = _folder(spark, "results")
    o = _t(spark, sf_dir, "orders")
    o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.csv(f"{folder}/status.csv", header=True)
    o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_custkey").alias("most")).write.csv(f"{folder}/priority.csv", header=True)
    out = readers.read_results(spark, [f"{folder}/{name}.csv" for name in ("status", "absent", "priority")])
    return out.select(F.coalesce("o_orderstatus", F.lit("")).alias("status"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"), F.col("n").cast("long").alias("n"), F.coalesce(F.col("most").cast("long"), F.lit(-1)).alias("most"))


def s11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as CSV and another as JSON, read again."""
    folder = _folder(spark, "summary")
    o = _t(spark, sf_dir, "orders")
    sinks.write_summary(o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")), f"{folder}/by_status")
    sinks.write_summary(o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")), f"{folder}/by_priority", "json")
    a = spark.read.csv(f"{folder}/by_status", header=True, schema="o_orderstatus string, n long, keys long").withColumnRenamed("o_orderstatus", "name")
    return a.unionByName(spark.read.json(f"{folder}/by_priority", schema="o_orderpriority string, n long, keys long").withColumnRenamed("o_orderpriority", "name"))


def s5_assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "assays")
    v = _folds(spark, sf_dir).select("o_orderstatus", F.concat(F.lit("A"), F.col("o_custkey").cast("string"), F.lit("G")).alias("mutant"), F.lit("ACD").alias("mutated_sequence"), F.col("o_totalprice").alias("DMS_score"), F.col("fold_random").alias("fold_random_5"), F.col("fold_modulo").alias("fold_modulo_5"), F.col("fold_contiguous").alias("fold_contiguous_5"))
    for status in ("F", "O"):
        v.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.csv(f"{path}/{status}.csv", header=True)
    return readers.read_assays(spark, path, ["F", "O"]).groupBy("dms_id").agg(F.count("*").alias("n"), F.count_distinct("mutant").alias("mutants"), F.sum("fold_modulo_5").alias("folds"), F.round(F.sum("DMS_score"), 2).alias("total"))


def s7_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "prepared")
    sinks.write_prepared(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, "lang")
    return readers.read_prepared(spark, path, lang="de").select("doc_id", "n_chars")


def f1_single_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.single_label(_t(spark, sf_dir, "documents"), "lang", "es", 3).groupBy("lang").agg(F.count("*").alias("n"))


def f2_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("text", F.when(F.pmod("doc_id", F.lit(3)) > 0, F.col("text")))
    return P.with_text_flag(docs, "text").where("has_text").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def f3_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", (F.pmod("p_size", F.lit(7)) == 0).alias("multiple"), F.col("p_size").alias("length"), F.col("p_retailprice").cast("int").alias("singles"))
    return P.eligible(part, "multiple", "length", "singles", longest=40, least=950, most=1050).select("p_partkey")


def f4_base_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("base", P.base_key(F.col("o_orderpriority")))
    return o.groupBy("base", (F.col("base") != F.col("o_orderpriority")).alias("changed")).agg(F.count("*").alias("n"))


def f7_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_index(_t(spark, sf_dir, "documents"), "source").select("doc_id", "label_index")


def f8_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(P.truncated(F.col("text"), 512)).alias("characters"))


def j1_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("priority"), F.count("*").alias("orders"))
    return P.annotated(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), totals, "c_custkey")


def j2_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("numbers"))


def a1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("note", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("source")))
    return P.cohort_profile(docs, "lang", ["text", "note"], {"long": F.col("n_chars") > 2000, "test": F.pmod("doc_id", F.lit(10)) == 0})


def a2_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_counts(_t(spark, sf_dir, "documents"), "lang")


def k6_majority_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.majority_floor(_t(spark, sf_dir, "documents"), "lang")


def a3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.group_metadata(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey")


def a4_fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fold_counts(_folds(spark, sf_dir), "o_orderstatus", SCHEMES)


def a18_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, seen = sinks.with_ledger(_t(spark, sf_dir, "documents"), "documents", {"rows": F.count("*"), "characters": F.sum("n_chars")})
    observed.groupBy("lang").count().write.format("noop").mode("overwrite").save()
    return sinks.ledger_rows(spark, {"documents": seen})


def w1_first_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_by_group(_t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name"), "c_mktsegment", "c_custkey", ["BUILDING", "MACHINERY"])


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), _t(spark, sf_dir, "supplier").select("s_acctbal", F.col("s_nationkey").alias("k"))
    return G.union(a, b, tolerant=True).groupBy("k").agg(F.count("c_acctbal").alias("customers"), F.count("s_acctbal").alias("suppliers"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as variants of a target of 150 residues: a third have two substitutions, some are malformed or do not fit."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    at = lambda c: F.substring(F.lit(letters), F.pmod(c, F.lit(20)).cast("int") + 1, 1)
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    one = F.concat(at(F.col("user_id") + F.when(F.pmod("event_id", F.lit(97)) == 0, 1).otherwise(0)), (F.col("user_id") + 1).cast("string"), at(F.col("event_id")))
    two = F.concat(at(F.col("user_id") + 3), (F.col("user_id") + 4).cast("string"), at(F.col("event_id") + 1))
    return e.withColumn("mutant", F.when(F.pmod("event_id", F.lit(89)) == 0, "A0").when(F.pmod("event_id", F.lit(3)) == 0, F.concat_ws(":", one, two)).otherwise(one))


def t10_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import substitutions

    v = _variants(spark, sf_dir).withColumn("subs", substitutions(F.col("mutant"), True))
    return v.select("event_id", F.coalesce(F.array_join(F.transform("subs", lambda s: F.concat_ws("/", s["pos"].cast("string"), s["wt"], s["mut"])), ","), F.lit("malformed")).alias("parsed"))


def t11_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import substitutions

    target = F.lit("".join("ACDEFGHIKLMNPQRSTVWY"[i % 20] for i in range(140)))
    v = _variants(spark, sf_dir).withColumn("subs", substitutions(F.col("mutant"), True)).withColumn("target", target)
    first = F.col("subs")[0]
    mutated = F.concat(F.substring("target", 1, 0), F.expr("substring(target, 1, subs[0].pos)"), first["mut"], F.expr("substring(target, subs[0].pos + 2)"))
    fault = P.variant_faults(F.col("target"), F.coalesce(mutated, F.col("target")), F.col("subs"))
    return v.groupBy(F.coalesce(fault, F.lit("fits")).alias("fault")).agg(F.count("*").alias("n"))


def t12_position_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return G.check(docs.select("doc_id", P.position_faults(F.col("text"), F.pmod("doc_id", F.lit(700)), 512).alias("bad")), {"position": F.col("bad"), "no id": F.col("doc_id").isNull()}).select("rule", "n_bad")


def u2_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import substitutions

    return P.distinct_positions(_variants(spark, sf_dir).withColumn("subs", substitutions(F.col("mutant"), True)), "subs")


def x3_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.duplicated(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_LETTERS = "'ACDEFGHIKLMNPQRSTVWY'"
_V = f"""WITH e AS (SELECT event_id, user_id, substr({_LETTERS}, ((user_id + (event_id % 97 = 0)::INT) % 20 + 1)::INT, 1) AS w1, substr({_LETTERS}, (event_id % 20 + 1)::INT, 1) AS m1,
  substr({_LETTERS}, ((user_id + 3) % 20 + 1)::INT, 1) AS w2, substr({_LETTERS}, ((event_id + 1) % 20 + 1)::INT, 1) AS m2, event_id % 89 = 0 AS bad, event_id % 3 = 0 AS two FROM events)
"""
QUERIES = {f.__name__: f for f in (s1_labelled_fasta, s3_annotations, s4_assay_reference, s5_assays, s10_results, s11_summary, s7_prepared, f1_single_label, f2_annotated, f3_eligible, f4_base_key, f7_label_index, f8_truncated, j1_annotated, j2_reference, a1_profile, a2_class_counts, k6_majority_floor, a3_metadata, a4_fold_counts, a18_ledger, w1_first_by_group, u1_union, t10_substitutions, t11_verified, t12_position_gate, u2_positions, x3_duplicates)}
SQL = {
    "s1_labelled_fasta": f"""SELECT 'D' || doc_id AS accession, upper(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS sequence, ({list(readers.LABELS)!r})[(doc_id % 10 + 1)::INT] AS localization, (['M', 'S', 'U'])[(doc_id % 3 + 1)::INT] AS solubility, doc_id % 4 = 0 AS is_test
      FROM documents WHERE regexp_matches(lower(text), '[a-z]')""",
    "s3_annotations": "SELECT 'D' || doc_id AS entry_accession, (length(text) + 1)::INT AS n_function, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS go_component, '' AS go_process, source AS go_function, lang AS keywords FROM documents",
    "s4_assay_reference": "SELECT 'P' || p_partkey AS DMS_id, CASE WHEN p_partkey % 9 > 0 THEN p_type ELSE '' END AS taxon, p_name AS target_seq, length(p_name)::INT AS seq_len, p_size % 3 = 0 AS includes_multiple_mutants, trunc(p_retailprice)::INT AS DMS_number_single_mutants FROM part",
    "s10_results": "SELECT o_orderstatus AS status, '' AS priority, count(*) AS n, -1::BIGINT AS most FROM orders GROUP BY 1 UNION ALL SELECT '', o_orderpriority, count(*), max(o_custkey)::BIGINT FROM orders GROUP BY 2",
    "s11_summary": "SELECT o_orderstatus AS name, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), sum(o_custkey)::BIGINT FROM orders GROUP BY 1",
    "s5_assays": "SELECT o_orderstatus AS dms_id, count(*) AS n, count(DISTINCT o_custkey) AS mutants, sum(o_custkey % 5)::BIGINT AS folds, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "s7_prepared": "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'",
    "f1_single_label": "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY lang",
    "f2_annotated": "SELECT lang, count(*) AS n, sum(length(t))::BIGINT AS characters FROM (SELECT lang, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents WHERE doc_id % 3 > 0) WHERE length(t) > 0 GROUP BY lang",
    "f3_eligible": "SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND p_size <= 40 AND trunc(p_retailprice) BETWEEN 950 AND 1050",
    "f4_base_key": "SELECT split_part(o_orderpriority, '-', 1) AS base, split_part(o_orderpriority, '-', 1) <> o_orderpriority AS changed, count(*) AS n FROM orders GROUP BY ALL",
    "f7_label_index": "SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label_index FROM documents",
    "f8_truncated": "SELECT lang, sum(least(length(text), 512))::BIGINT AS characters FROM documents GROUP BY lang",
    "j1_annotated": "SELECT c_custkey, c_mktsegment, coalesce(priority, '') AS priority, orders FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS priority, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "j2_reference": "SELECT p_type, count(*) AS n, sum(l_linenumber)::BIGINT AS numbers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
    "a1_profile": "SELECT count(*) AS n, count(DISTINCT lang) AS n_classes, count(*) FILTER (n_chars > 2000) AS n_long, count(*) FILTER (doc_id % 10 = 0) AS n_test, count(*) FILTER (length(text) > 0) AS n_text, count(*) FILTER (doc_id % 4 = 0 AND length(source) > 0) AS n_note, count(*) FILTER (length(text) > 0) / count(*) AS share_text, count(*) FILTER (doc_id % 4 = 0 AND length(source) > 0) / count(*) AS share_note FROM documents",
    "a2_class_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "k6_majority_floor": "SELECT max(n) / sum(n) AS majority_floor FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "a3_metadata": "SELECT l_returnflag, count(*) AS variants, count(DISTINCT l_partkey) AS distinct_positions FROM lineitem GROUP BY 1",
    "a4_fold_counts": "SELECT o_orderstatus, s.scheme, CASE s.scheme WHEN 'fold_random' THEN a WHEN 'fold_modulo' THEN b ELSE c END AS folds FROM (SELECT o_orderstatus, count(DISTINCT (o_orderkey * 7 + 3) % 5) AS a, count(DISTINCT o_custkey % 5) AS b, count(DISTINCT (o_custkey // 10) % 5) AS c FROM orders GROUP BY 1), (VALUES ('fold_random'), ('fold_modulo'), ('fold_contiguous')) s(scheme)",
    "a18_ledger": "SELECT 'documents' AS step, 'rows' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'documents', 'characters', sum(n_chars)::DOUBLE FROM documents",
    "w1_first_by_group": "SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment)",
    "u1_union": "SELECT k, count(c) AS customers, count(s) AS suppliers FROM (SELECT c_nationkey AS k, c_acctbal AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) GROUP BY k",
    "t10_substitutions": _V + "SELECT event_id, CASE WHEN bad THEN 'malformed' ELSE user_id || '/' || w1 || '/' || m1 || CASE WHEN two THEN ',' || (user_id + 3) || '/' || w2 || '/' || m2 ELSE '' END END AS parsed FROM e",
    "t11_verified": _V + f"SELECT CASE WHEN bad THEN 'malformed' WHEN two THEN 'not one substitution' WHEN user_id >= 140 THEN 'position out of range' WHEN w1 <> substr({_LETTERS}, (user_id % 20 + 1)::INT, 1) THEN 'target has another residue' ELSE 'fits' END AS fault, count(*) AS n FROM e GROUP BY 1",
    "t12_position_gate": "SELECT 'position' AS rule, count(*) FILTER (doc_id % 700 >= least(length(text), 512)) AS n_bad FROM documents UNION ALL SELECT 'no id', count(*) FILTER (doc_id IS NULL) FROM documents",
    "u2_positions": _V + "SELECT user_id::INT AS position FROM e WHERE NOT bad UNION SELECT (user_id + 3)::INT FROM e WHERE two AND NOT bad",
    "x3_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
}
