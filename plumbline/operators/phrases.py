"""Terms found through an index of phrases: the cost of a text does not depend on how many terms there are.

A text is taken apart into runs of word characters and the runs between them. Every span of a term's length that begins
with a term's first word (any word, if there are more than ``FIRSTS`` of these) is looked up in a table of the terms and
their regular plurals: a broadcast up to ``BROADCAST`` forms, a shuffled join beyond. What a pattern of all terms would find is then chosen among
the spans that met: from the left, the longest term at each place, none over another. Exclusions are found first in the
same way, and terms that touch one do not count. So the result is that of ``functions.text.term_pattern``.

Terms begin and end with a word character; others, which few lexicons have, are left to the pattern, and a term of one
kind is reported beside one of the other that it overlaps. Blank terms, or
none at all, are an error. Null and empty texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import in_pieces
from ..functions.shared import cut
from ..functions.text import clean_annotation, sentences, term_pattern

#: Forms of terms that are broadcast at most.
BROADCAST = 1 << 20
#: First words of forms by which places are chosen; with more of them every word is looked up.
FIRSTS = 1000
_PARTS = r"(?U)\w+|\W+"


def phrase_table(terms: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
    """form, term, size (runs), length, kind of the terms (a column ``term``) and their plurals; and the terms that are left to a pattern."""
    listed = terms.select("term").distinct()
    if not listed.take(1) or listed.where("term is null or trim(term) = ''").take(1):
        raise ValueError("terms must be given and none may be blank")
    whole = F.col("term").rlike(r"(?U)^\w(.*\w)?$")
    odd = [r.term for r in listed.where(~whole).orderBy("term").limit(1001).collect()]
    if len(odd) > 1000:
        raise ValueError("more than 1000 terms begin or end with a mark")
    low = F.lower("term")
    both = listed.where(whole).groupBy(low.alias("low")).agg(F.min("term").alias("term"))
    forms = both.select("low", F.explode(F.array("low", F.concat("low", F.lit("s")))).alias("form"))
    # a term that is the plural of another one stands for itself
    best = forms.groupBy("form").agg(F.max_by("low", F.length("low")).alias("term"))
    return best.select("form", "term", F.size(F.regexp_extract_all("form", F.lit(_PARTS), 0)).alias("size"), F.length("form").alias("length"), F.lit(kind).alias("kind")), odd


def _looked_up(texts: DataFrame, keys: list[str], table: DataFrame, sizes: list[int], firsts: list[str]) -> DataFrame:
    """keys, kind, term, at (place of the first run), end, length: every span of ``texts`` (keys, text) that is a form of the table.

    ``firsts`` holds the words that forms begin with: spans are made at these only. Without any, they are made at every word.
    """
    parts = texts.select(*keys, F.explode(F.array(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_PARTS), 0))).alias("_p")).where("size(_p) > 0")
    # words stand at every other place: at the first one, or behind a run of other marks
    first = F.when(F.col("_p")[0].rlike(r"(?U)^\w"), 0).otherwise(1)
    words = F.filter(F.sequence(first, F.greatest(F.size("_p") - 1, first), F.lit(2)), lambda i: i < F.size("_p"))
    begun = F.filter(words, lambda i: F.get("_p", i).isin(firsts)) if firsts else words
    parts = parts.select(*keys, "_p", F.explode(F.array(begun)).alias("_i")).where("size(_i) > 0")
    # a span carries its own text, not that of the sentence
    spans = lambda n: F.transform(F.filter("_i", lambda i: i + n <= F.size("_p")), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("_p", i + 1, n), "").alias("form")))
    flat = parts.select(*keys, F.explode(F.concat(*[spans(n) for n in sizes])).alias("_s")).select(*keys, "_s.*")
    return flat.join(table, ["form", "size"]).select(*keys, "kind", "term", "at", (F.col("at") + F.col("size")).alias("end"), "length")


def _chosen(spans: Column) -> Column:
    """Of spans (at, length, end, term) those that a pattern finds: from the left, the longest, none over another."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), (-s["length"]).alias("minus"), s["end"].alias("end"), s["term"].alias("term"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,minus:int,end:int,term:string>>").alias("out"))
    step = lambda state, s: F.when(s["at"] < state["end"], state).otherwise(F.struct(s["end"].alias("end"), F.concat(state["out"], F.array(s)).alias("out")))
    return F.aggregate(ordered, start, step, lambda state: state["out"])


def matched_by_index(texts: DataFrame, keys: list[str], terms: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """keys, matched: the sorted distinct terms, in lower case, of the texts (keys, text) that match any."""
    table, odd = phrase_table(terms, "term")
    odd_exclusions: list[str] = []
    if exclusions is not None:
        more, odd_exclusions = phrase_table(exclusions, "exclusion")
        table = table.unionByName(more)
    table = cut(table, "phrases")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # lengths of terms
    if odd_exclusions:  # a pattern can blank these only; no other exclusion overlaps a mark at their ends
        texts = texts.withColumn("text", F.regexp_replace("text", term_pattern(odd_exclusions), " "))
    firsts = [r[0] for r in table.select(F.regexp_extract("form", r"(?U)^\w+", 0)).distinct().limit(FIRSTS + 1).collect()]
    spans = _looked_up(texts, keys, F.broadcast(table) if table.count() <= BROADCAST else table, sizes, firsts if len(firsts) <= FIRSTS else [])
    struct = F.struct("at", "length", "end", "term")
    by_text = spans.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("kind") == k, struct)).alias(k) for k in ("term", "exclusion")])
    excused = by_text.select(*keys, "term", _chosen(F.col("exclusion")).alias("out"))
    free = F.filter("term", lambda t: ~F.exists("out", lambda e: (t["at"] < e["end"]) & (e["at"] < t["end"])))
    found = excused.select(*keys, F.array_sort(F.array_distinct(F.transform(_chosen(free), lambda s: s["term"]))).alias("matched")).where("size(matched) > 0")
    if not odd:
        return found
    by_pattern = texts.select(*keys, F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(term_pattern(odd)), 1), F.lower)).alias("matched")).where("size(matched) > 0")
    both = found.unionByName(by_pattern).groupBy(*keys).agg(F.flatten(F.collect_list("matched")).alias("matched"))
    return both.select(*keys, F.array_sort(F.array_distinct("matched")).alias("matched"))


def ablate_by_index(df: DataFrame, key: str, text: str, terms: DataFrame, exclusions: DataFrame | None = None, clean: bool = True) -> DataFrame:
    """key, kept, removed, matched_terms, characters_before, characters_after of each row: as ``ablation.ablate``, for lexicons of any size.

    The sentences of a row are written once, as one array; they are looked up one by one, and what was found meets the array again.
    """
    cleaned = clean_annotation(F.col(text)) if clean else F.coalesce(F.col(text), F.lit(""))
    rows = cut(in_pieces(df.select(key, text)).select(F.col(key), sentences(cleaned).alias("_all"), F.monotonically_increasing_id().alias("_row")), "sentences")
    hits = matched_by_index(rows.select("_row", F.posexplode("_all").alias("place", "text")), ["_row", "place"], terms, exclusions)
    item = "array<struct<place:int,text:string,matched:array<string>>>"
    found = hits.groupBy("_row").agg(F.collect_list(F.struct("place", F.lit(None).cast("string").alias("text"), "matched")).cast(item).alias("_found"))
    said = F.transform("_all", lambda t, i: F.struct(i.alias("place"), t.alias("text"), F.lit(None).cast("array<string>").alias("matched"))).cast(item)
    # in this order a hit, which has no text, stands right before its sentence
    both = rows.join(found, "_row", "left").select(key, F.explode(F.array(F.array_sort(F.concat(said, F.coalesce("_found", F.array().cast(item)))))).alias("_b"))
    before = lambda i: F.get("_b", i - 1)
    paired = F.filter(F.transform("_b", lambda x, i: F.struct(x["text"].alias("text"), F.when(before(i)["text"].isNull(), before(i)["matched"]).alias("matched"))), lambda x: x["text"].isNotNull())
    told = both.select(key, F.explode(F.array(paired)).alias("s"))
    of = lambda hit: F.transform(F.filter("s", lambda x: x["matched"].isNotNull() if hit else x["matched"].isNull()), lambda x: x["text"])
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + F.length(s))
    matched = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("s", lambda x: x["matched"].isNotNull()), lambda x: x["matched"]))))
    split = told.select(key, "s", of(False).alias("kept"), of(True).alias("removed"), matched.alias("matched_terms"))
    return split.select(key, "kept", "removed", "matched_terms", size(F.transform("s", lambda x: x["text"])).alias("characters_before"), size("kept").alias("characters_after"))
