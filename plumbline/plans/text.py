"""Sentence-level ablation over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BOOKKEEPING, BREAK, DOT, SEMICOLON, clean_annotation, holds_private, joined_fields, normalised, random_dropped, sentences
from ..operators import ablation as A
from ..operators.phrases import ablate_by_index

LEXICON = A.Lexicon(
    version="1",
    groups={"license": ("license", "licensed", "copyright", "warranty", "rights reserved"), "function": ("that", "with", "from", "von", "avec"), "place": ("for", "pour", "para")},
    exclusions=("Apache License", "for the"),
    sentinels=("the", "version", "between"),
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def _ablated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ablate(_docs(spark, sf_dir), "text", LEXICON)


def t1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = _docs(spark, sf_dir).withColumn("noisy", F.concat(F.lit("FUNCTION: Begins {ECO:0001|PubMed:2}. . "), F.col("text"), F.lit(" (PubMed:12, ECO:3) (By similarity) ; end ( ) .;")))
    return noisy.select("doc_id", clean_annotation(F.col("noisy")).alias("cleaned"))


def t2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", sentences(clean_annotation(F.col("text"))).alias("sentences"))
    return docs.select("doc_id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("joined"))


def t5_ablate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _ablated(spark, sf_dir)
    return a.select("doc_id", F.array_join("kept", " ").alias("kept_text"), F.size("removed").alias("n_removed"), F.array_join("matched_terms", ",").alias("terms"), "characters_before", "characters_after")


def t4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As t5_ablate, by looking phrases up instead of a pattern."""
    entries = LEXICON.frame(spark)
    a = ablate_by_index(_docs(spark, sf_dir), "doc_id", "text", entries.where("kind = 'term'"), entries.where("kind = 'exclusion'"))
    return a.select("doc_id", F.array_join("kept", " ").alias("kept_text"), F.size("removed").alias("n_removed"), F.array_join("matched_terms", ",").alias("terms"), "characters_before", "characters_after")


def t6_random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = random_dropped(F.col("sentences"), F.col("doc_id"), F.lit(7), F.size("removed"))
    return _ablated(spark, sf_dir).select("doc_id", F.array_join(dropped, " ").alias("control_text"), F.size(dropped).alias("n_kept"))


def t7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.text_variants(_ablated(spark, sf_dir), "doc_id", "text", (0, 1))
    return v.groupBy("variant", F.coalesce("seed", F.lit(-1)).alias("seed")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def t7_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.untouched_faults(_ablated(spark, sf_dir)).agg(F.count("*").alias("n_bad"))


def t3_private_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.pmod("doc_id", F.lit(50)) == 0, F.concat("text", F.lit(DOT))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(holds_private(text), F.lit(False)).alias("private"))


def t8_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the lexicon with the number of documents that mention it."""
    entries = LEXICON.frame(spark)
    said = A.term_mentions(_docs(spark, sf_dir), F.col("text"), [*LEXICON.terms, *LEXICON.exclusions, *LEXICON.sentinels])
    return entries.join(said, "term").select("version", F.coalesce("group", F.lit("")).alias("group"), "term", "kind", "n")


def a7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ablation_summary(_ablated(spark, sf_dir), "lang")[0]


def a7_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ablation_summary(_ablated(spark, sf_dir), "lang")[1]


def a7_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ablation_summary(_ablated(spark, sf_dir), "lang")[2]


def a8_retention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retention_gate(_ablated(spark, sf_dir)).select("doc_id")


def a9_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.term_mentions(_docs(spark, sf_dir), F.col("text"), [*LEXICON.terms, "unheard of"])


def t9_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.term_mentions(_ablated(spark, sf_dir), F.array_join("kept", " "), LEXICON.sentinels)


def a10_control_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.control_retention(_ablated(spark, sf_dir), "doc_id", 7)


def f5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalised(F.when(F.pmod("doc_id", F.lit(10)) > 0, F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", n.alias("text"), (F.length(n) > 0).alias("has_text"))


def f6_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m, c: F.when(F.pmod("doc_id", F.lit(m)) > 0, F.col(c))
    return _docs(spark, sf_dir).select("doc_id", joined_fields(part(2, "lang"), part(3, "source"), F.lit(None).cast("string"), part(5, "lang")).alias("structured"))


_SPACE = r"[ \t\n\x0B\f\r]"
_W = r"[\p{L}\p{M}\p{N}_]"


_DOT, _BREAK = f"chr({ord(DOT)})", f"chr({ord(BREAK)})"


def _sql_clean(c: str) -> str:
    patterns = [p.replace("(?U)", "").replace(r"\s", _SPACE) for p in BOOKKEEPING]
    for pattern, by in (*((p, "") for p in patterns), (f"{_SPACE}+", " "), (" ([.;,:])", r"\1"), (r"\( ?\)", ""), ("([.;])[.;]+", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim(ltrim({c}, '.;,: '))"


def _sql_sentences(c: str) -> str:
    """Without the protected marks of other texts: the driver's documents hold no brackets with marks and no listed abbreviation but these."""
    marked = c
    for _ in range(2):
        marked = rf"regexp_replace({marked}, '([0-9])\.([0-9])', '\1' || {_DOT} || '\2', 'g')"
    marked = rf"regexp_replace({marked}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z])\.( +[a-z])', '\1\2' || {_DOT} || '\3', 'g')"
    for a, b in (("e", "g"), ("i", "e")):
        marked = rf"regexp_replace({marked}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({a})\.({b})\.', '\1\2' || {_DOT} || '\3' || {_DOT}, 'g')"
    for a in ("spp", "sp", "cf", "approx", "vs", "etc"):
        marked = rf"regexp_replace({marked}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({a})\.', '\1\2' || {_DOT}, 'g')"
    parts = rf"string_split(regexp_replace({marked}, '([.;]) +', '\1' || {_BREAK}, 'g'), {_BREAK})"
    return f"list_filter(list_transform({parts}, lambda s: trim(replace(s, {_DOT}, '.'))), lambda s: trim(s, ' .;,:') <> '')"


def _sql_pattern(terms) -> str:
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return "(?i)(^|[^" + _W[1:-1] + "])(" + "|".join(ordered) + ")s?($|[^" + _W[1:-1] + "])"


def _sql_blank(s: str) -> str:
    # twice, as neighbouring phrases share the mark between them
    once = rf"regexp_replace({s}, '{_sql_pattern(LEXICON.exclusions)}', '\1 \3', 'g')"
    return rf"regexp_replace({once}, '{_sql_pattern(LEXICON.exclusions)}', '\1 \3', 'g')"


def _sql_term(t: str) -> str:
    return f"(?i)(^|[^{_W[1:-1]}]){t}s?($|[^{_W[1:-1]}])"


_BASE = f"""
WITH s AS (SELECT doc_id, lang, text, {_sql_clean("text")} AS cleaned FROM documents), p AS (SELECT *, {_sql_sentences("cleaned")} AS sents FROM s),
u AS (SELECT doc_id, unnest(sents) AS sent, unnest(range(0, len(sents))) AS i FROM p), b AS (SELECT *, {_sql_blank("sent")} AS blank FROM u),
h AS (SELECT doc_id, sent, i, blank, regexp_matches(blank, '{_sql_pattern(LEXICON.terms)}') AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || i), i) AS place FROM b),
n AS (SELECT doc_id, count(*) FILTER (hit) AS n_removed FROM h GROUP BY doc_id),
g AS (SELECT doc_id, list(sent ORDER BY i) FILTER (NOT hit) AS kept, list(sent ORDER BY i) FILTER (hit) AS removed, list(sent ORDER BY i) FILTER (place > n_removed) AS control, sum(length(sent)) AS before, sum(length(sent)) FILTER (NOT hit) AS after FROM h JOIN n USING (doc_id) GROUP BY doc_id),
tm AS ({" UNION ".join(f"SELECT doc_id, '{t}' AS term FROM h WHERE hit AND regexp_matches(blank, '{_sql_term(t)}')" for t in LEXICON.terms)}),
tl AS (SELECT doc_id, list(term ORDER BY term) AS terms FROM tm GROUP BY doc_id),
r AS (SELECT p.doc_id, p.lang, p.text, p.cleaned, p.sents, coalesce(kept, []) AS kept, coalesce(removed, []) AS removed, coalesce(control, []) AS control, coalesce(terms, []) AS terms, coalesce(before, 0)::BIGINT AS characters_before, coalesce(after, 0)::BIGINT AS characters_after
  FROM p LEFT JOIN g USING (doc_id) LEFT JOIN tl USING (doc_id)), c AS (SELECT * FROM r)
"""


def _sql_mentions(relation: str, column: str, terms) -> str:
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (regexp_matches({column}, '(?i)(^|[^{_W[1:-1]}]){t}s?($|[^{_W[1:-1]}])')) AS n FROM {relation}" for t in terms)
    return rows


QUERIES = {f.__name__: f for f in (t5_ablate, t4_phrase_index, t1_clean, t2_sentences, t6_random_control, t7_variants, t7_invariant, t3_private_points, t8_lexicon, a7_summary, a7_by_lang, a7_by_term, a8_retention_gate, a9_mentions, t9_sentinels, a10_control_retention, f5_normalised, f6_joined)}
SQL = {
    "t1_clean": "SELECT doc_id, " + _sql_clean("('FUNCTION: Begins {ECO:0001|PubMed:2}. . ' || text || ' (PubMed:12, ECO:3) (By similarity) ; end ( ) .;')") + " AS cleaned FROM documents",
    "t2_sentences": f"SELECT doc_id, len(s)::INT AS n_sentences, array_to_string(s, '|') AS joined FROM (SELECT doc_id, {_sql_sentences(_sql_clean('text'))} AS s FROM documents)",
    "t5_ablate": _BASE + "SELECT doc_id, array_to_string(kept, ' ') AS kept_text, len(removed)::INT AS n_removed, array_to_string(list_sort(terms), ',') AS terms, characters_before::INT AS characters_before, characters_after::INT AS characters_after FROM r",
    "t6_random_control": _BASE + "SELECT doc_id, array_to_string(control, ' ') AS control_text, len(control)::INT AS n_kept FROM c",
    "a7_summary": _BASE + """SELECT count(*) AS documents, count(*) FILTER (len(removed) > 0) AS trimmed, count(*) FILTER (len(removed) > 0 AND len(kept) = 0) AS emptied,
      count(*) FILTER (len(removed) > 0) / count(*) AS trimmed_share, count(*) FILTER (len(removed) > 0 AND len(kept) = 0) / count(*) AS emptied_share,
      sum(len(sents))::BIGINT AS sentences, sum(len(removed))::BIGINT AS sentences_removed, sum(characters_before)::BIGINT AS characters_before, sum(characters_after)::BIGINT AS characters_after,
      sum(characters_after) / sum(characters_before) AS corpus_retention, avg(characters_after / characters_before) FILTER (characters_before > 0) AS retention_mean,
      quantile_cont(CASE WHEN characters_before > 0 THEN characters_after / characters_before END, 0.5) AS retention_median, quantile_cont(CASE WHEN characters_before > 0 THEN characters_after / characters_before END, 0.1) AS retention_p10,
      count(*) FILTER (characters_before = 0) AS undefined_retention FROM r""",
    "a7_by_lang": _BASE + "SELECT lang, count(*) AS documents, count(*) FILTER (len(removed) > 0) AS trimmed, count(*) FILTER (len(removed) > 0 AND len(kept) = 0) AS emptied, sum(len(removed))::BIGINT AS sentences_removed FROM r GROUP BY lang",
    "a7_by_term": _BASE + "SELECT term, count(*) AS documents FROM (SELECT unnest(terms) AS term FROM r) GROUP BY term",
    "a8_retention_gate": _BASE + "SELECT doc_id FROM r WHERE characters_before = 0 OR (len(kept) = 0 AND len(removed) = 0)",
    "a9_mentions": _sql_mentions("documents", "text", [*LEXICON.terms, "unheard of"]),
    "t9_sentinels": _BASE + ", j AS (SELECT array_to_string(kept, ' ') AS t FROM r) " + _sql_mentions("j", "t", LEXICON.sentinels),
    "t7_variants": _BASE + """, x AS (SELECT seed, doc_id, sent, i, n_removed, row_number() OVER (PARTITION BY doc_id, seed ORDER BY md5(seed || ':' || doc_id || ':' || i), i) AS place FROM h JOIN n USING (doc_id), (VALUES (0), (1)) v(seed)),
      y AS (SELECT seed, doc_id, string_agg(sent, ' ' ORDER BY i) FILTER (place > n_removed) AS t FROM x GROUP BY ALL)
      SELECT 'raw' AS variant, -1 AS seed, count(*) AS n, sum(length(text))::BIGINT AS characters FROM r UNION ALL SELECT 'cleaned', -1, count(*), sum(length(cleaned))::BIGINT FROM r
      UNION ALL SELECT 'ablated', -1, count(*), sum(length(array_to_string(kept, ' ')))::BIGINT FROM r UNION ALL SELECT 'random', seed, (SELECT count(*) FROM r), sum(coalesce(length(t), 0))::BIGINT FROM y GROUP BY seed""",
    "t7_invariant": _BASE + "SELECT count(*) FILTER (len(removed) = 0 AND array_to_string(kept, ' ') <> array_to_string(sents, ' ')) AS n_bad FROM r",
    "t3_private_points": f"SELECT doc_id, coalesce(regexp_matches(t, '[' || {_DOT} || chr({ord(SEMICOLON)}) || {_BREAK} || ']'), false) AS private FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN text || {_DOT} ELSE text END AS t FROM documents)",
    "t8_lexicon": "WITH m AS (" + _sql_mentions("documents", "text", [*LEXICON.terms, *LEXICON.exclusions, *LEXICON.sentinels]) + "), e AS (" + " UNION ALL ".join(
        f"SELECT '{LEXICON.version}' AS version, '{g}' AS \"group\", '{t}' AS term, '{k}' AS kind" for g, t, k in [*((g, t, "term") for g, ts in LEXICON.groups.items() for t in ts), *(("", t, "exclusion") for t in LEXICON.exclusions), *(("", t, "sentinel") for t in LEXICON.sentinels)]
    ) + ") SELECT version, \"group\", term, kind, n FROM e JOIN m USING (term)",
    "a10_control_retention": _BASE + """SELECT sum(characters_before)::BIGINT AS before, sum(characters_after)::BIGINT AS ablated, sum(coalesce(list_sum(list_transform(control, lambda x: length(x))), 0))::BIGINT AS control,
      sum(characters_after) / sum(characters_before) AS ablated_retention, sum(coalesce(list_sum(list_transform(control, lambda x: length(x))), 0)) / sum(characters_before) AS control_retention FROM c""",
    "f5_normalised": f"SELECT doc_id, t AS text, length(t) > 0 AS has_text FROM (SELECT doc_id, trim(regexp_replace(coalesce(CASE WHEN doc_id % 10 > 0 THEN text END, ''), '{_SPACE}+', ' ', 'g')) AS t FROM documents)",
    "f6_joined": "SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 2 > 0 THEN lang END, '') || '; ' || coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') || '; ; ' || coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, ''), '; ') AS structured FROM documents",
}
SQL["t4_phrase_index"] = SQL["t5_ablate"]
