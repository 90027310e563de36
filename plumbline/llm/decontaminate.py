"""Benchmark decontamination by templates (operator 10), with DataFrame functions only.

Texts become template words: numbers, capitalised names and units after numbers turn into typed placeholders. Windows of
``WINDOW`` template words of the benchmark and of the documents meet in a hash join; a broadcast bitmap keeps the windows
that no item has out of the shuffle. A document's window is one row however many items have it; pairs of a document and
an item are only made by windows that must be there if it leaks (see ``_telling``), so that a stem that many items share
makes none. A window with fewer than ``LITERALS`` plain words would match anything by its
template: it is matched on its words as written instead. An item with fewer words than a window is one shorter window,
and documents are then read in windows of that length as well.

A document leaks an item when windows that cover ``SHARE`` of the item are found along alignments whose slots are
consistent (within one alignment, equal values of the item stand for equal values in the document), or when one
alignment holds ``RUN`` words of the item in a row as they are written. So verbatim passages, excerpts of long items and
re-parameterised questions are caught.

Null texts count as empty and leak nothing. Rows with a null doc_id are not reported, but :func:`without_leaks` judges
each text whatever its doc_id is. Repeated documents are reported once for each doc_id. Either table may be empty. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, marked_by, may_hold, table, unused

WINDOW, LITERALS, SHARE, RUN = 8, 4, 0.5, 13
#: Number words and units. Words for one are articles or pronouns too, and are left out.
NUMBER_WORDS = (
    "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "half", "twice",
    "zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente", "quarante", "cinquante", "soixante", "cent", "cents", "mille", "millions",
    "null", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "cero", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "ciento", "mil", "millones",
)
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounces",
    "ml", "l", "litre", "litres", "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "meter", "meters", "metre", "metres", "kilometers", "kilometres",
    "mètre", "mètres", "kilomètres", "grammes", "kilogrammes", "seconde", "secondes", "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "degrés",
    "metro", "metros", "kilómetros", "gramos", "kilogramos", "segundo", "segundos", "minutos", "hora", "horas", "día", "días", "semana", "semanas", "mes", "meses", "año", "años", "grados",
)


def raw_words(text: Column) -> Column:
    """Words of letters and digits, as they are written; separators within numbers are left out."""
    whole = F.coalesce(text, F.lit(""))
    plain = whole
    for _ in range(2):  # neighbouring separators overlap
        plain = F.regexp_replace(plain, r"([0-9])[.,]([0-9])", "$1$2")
    plain = F.when(whole.rlike("[0-9][.,][0-9]"), plain).otherwise(whole)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " "))


def template(raw: Column) -> Column:
    """One template word for each word of ``raw``, between single spaces."""
    s = F.concat(F.lit(" "), F.replace(raw, F.lit(" "), F.lit("  ")), F.lit(" "))
    s = F.regexp_replace(s, r" \p{Lu}[^ ]* ", " <name> ")
    firsts = "".join(sorted({w[0] for w in NUMBER_WORDS}))
    s = F.regexp_replace(s, f" (?=[0-9{firsts}])(?:[0-9][^ ]*|{'|'.join(NUMBER_WORDS)}) ", " <num> ")
    s = F.when(s.contains("<num>"), F.regexp_replace(s, f" <num>  (?:{'|'.join(UNITS)}) ", " <num>  <unit> ")).otherwise(s)
    return F.trim(F.replace(s, F.lit("  "), F.lit(" ")))


def _split(column: str) -> Column:
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, " "))


def _literals(words: list[Column]) -> Column:
    """How many of some template words are no placeholders."""
    out = F.lit(0)
    for w in words:
        out = out + F.when(w.startswith("<"), 0).otherwise(1)
    return out


def _words(rows: DataFrame, key: str) -> DataFrame:
    """key, r, t: the words of ``text`` as written and their template words."""
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))  # noqa: E731  a generator: what stands behind it does not work ``c`` out again
    words = rows.select(key, once(raw_words(F.col("text")), "raw"))
    words = words.select(key, "raw", once(template(F.col("raw")), "template"))
    return words.select(key, "raw", once(_split("template"), "t")).select(key, "t", once(_split("raw"), "r"))


def windows(rows: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """key, pos, hash of each window of ``size`` words of ``text``: those with LITERALS plain words by template, the others as written.

    Only places are exploded: a window reads its words where they are in the word arrays, so that no text and no array is put together for it.
    """
    flat = _words(rows, key).where(F.size("t") >= size).select(key, "t", "r", F.explode(F.sequence(F.lit(0), F.size("t") - size)).alias("pos"))
    at = lambda c: [F.get(c, F.col("pos") + k) for k in range(size)]
    part = lambda c: F.xxhash64(F.lit(c), *at(c))
    return flat.select(key, "pos", F.when(_literals(at("t")) >= LITERALS, part("t")).otherwise(part("r")).alias("hash"))


def short_windows(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """As :func:`windows`, of all of some shorter sizes in one pass."""

    def one(size: int) -> Column:
        at = lambda c, i, k: F.get(c, i + k)
        plain = lambda i: sum((F.when(at("t", i, k).startswith("<"), 0).otherwise(1) for k in range(size)), F.lit(0))
        part = lambda c, i: F.xxhash64(F.lit(c), *[at(c, i, k) for k in range(size)])
        each = lambda i: F.struct(i.alias("pos"), F.when(plain(i) >= LITERALS, part("t", i)).otherwise(part("r", i)).alias("hash"))
        return F.when(F.size("t") >= size, F.transform(F.sequence(F.lit(0), F.size("t") - size), each)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return _words(rows, key).select(key, F.inline(F.concat(*[one(n) for n in sizes])))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_pos, size, written, hash, and for every window its words as written and their kinds."""
    rows = benchmark.select("item_id", raw_words(F.col("text")).alias("raw")).select("item_id", "raw", template(F.col("raw")).alias("template"))
    rows = rows.select("item_id", _split("raw").alias("raw"), _split("template").alias("words")).withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where("size > 0")
    rows = rows.select("item_id", "raw", "words", "size", F.explode(F.expr("sequence(0, size(words) - size)")).alias("item_pos"))
    part = lambda c: F.expr(f"slice({c}, item_pos + 1, size)")
    rows = rows.select("item_id", "item_pos", "size", part("raw").alias("item_words"), part("words").alias("kinds"))
    rows = rows.withColumn("written", F.expr(f"size(filter(kinds, w -> not startswith(w, '<'))) < {LITERALS}"))
    at = lambda c, n: [F.col(c)[k] for k in range(n)]
    digest = F.lit(None).cast("long")
    for n in range(1, WINDOW + 1):
        digest = F.when(F.col("size") == n, F.when(F.col("written"), F.xxhash64(F.lit("r"), *at("item_words", n))).otherwise(F.xxhash64(F.lit("t"), *at("kinds", n)))).otherwise(digest)
    return rows.withColumn("hash", digest)


#: Rows of the benchmark's windows that are broadcast at most.
FEW = 1 << 18


def _small(written: DataFrame) -> DataFrame:
    """A written table, broadcast if it is of few rows."""
    return F.broadcast(written) if written.count() <= FEW else written


def _telling(items: DataFrame, counts: DataFrame, share: float, run: int) -> DataFrame:
    """item_id, hash: windows of which a document has at least one if it can leak the item.

    Who has ``share`` of an item's windows has one of its rarest ones, as many as may be missing and one more; who has
    ``run`` words in a row has all windows of a run, and so the rarest of it. Windows that very many items share (a common
    stem) tell only where an item has no rarer ones. Rarity is the number of items that have a window.
    """
    often = items.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    rated = items.select("item_id", "item_pos", "hash", "size").join(often, "hash").withColumn("rarity", F.struct("items", "hash"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("rarity"))
    distinct = rated.select("item_id", "hash", "rarity").distinct().withColumn("rank", rank).join(counts, "item_id")
    prefix = distinct.where(F.col("rank") <= F.col("windows") - F.greatest(F.ceil(F.lit(float(share)) * F.col("windows")), F.lit(1)) + 1).select("item_id", "hash")
    steps = run - WINDOW
    ahead = Window.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, steps)
    runs = rated.where(F.col("size") == WINDOW).withColumn("least", F.min("rarity").over(ahead)).withColumn("n", F.count("*").over(ahead))
    return prefix.unionByName(runs.where(F.col("n") == steps + 1).select("item_id", F.col("least.hash").alias("hash"))).distinct()


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, key: str = "doc_id") -> DataFrame:
    """key, item_id, windows of the item, how many were found, the share, the longest run of words as written, and whether all found slots are verbatim."""
    items = cut(item_windows(benchmark), "items")
    counts = items.groupBy("item_id").agg(F.count_distinct("hash").alias("windows"))
    docs = documents.select(F.col(key), "text").where(F.col(key).isNotNull())
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # WINDOW at most
    read = [windows(docs, key)] if WINDOW in sizes else []
    if short := [n for n in sizes if n < WINDOW]:
        read.append(short_windows(docs, key, short))
    none = docs.limit(0).select(key, F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash"))
    held_ = reduce(DataFrame.unionByName, read, none)
    known = cut(items.select("hash").distinct(), "hashes")
    # the windows of documents that some item has: one row each, however many items have them
    met = cut(marked_by(held_, "hash", known).where("marked").drop("marked").distinct().join(_small(known), "hash", "left_semi"), "met")
    pairs = met.select(key, "hash").distinct().join(_small(cut(_telling(items, counts, share, run), "telling")), "hash").select(key, "item_id").distinct()
    own = items.select("item_id", "item_pos", "hash")
    likely = cut(cut(pairs, "pairs").join(own, "item_id").join(met, [key, "hash"]).select("hash", key, "pos", "item_id", "item_pos").distinct(), "matches")

    def covered(m: DataFrame) -> DataFrame:
        n = m.groupBy(key, "item_id").agg(F.count_distinct("hash").alias("found"))
        return n.join(counts, "item_id")

    aligned_ = likely.groupBy(key, "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") > run - WINDOW)
    enough = covered(likely).where(F.col("found") >= share * F.col("windows")).select(key, "item_id").unionByName(aligned_.select(key, "item_id")).distinct()
    likely = cut(likely.join(enough, [key, "item_id"], "left_semi"), "likely")
    held = may_hold(docs, key, likely.select(key)).dropDuplicates([key, "text"]).select(key, raw_words(F.col("text")).alias("raw"))
    held = held.select(key, _split("raw").alias("raw")).join(likely, key).join(items.select("item_id", "item_pos", "item_words", "kinds", "written", "size"), ["item_id", "item_pos"])
    held = held.select(key, "item_id", "item_pos", "size", "hash", (F.col("pos") - F.col("item_pos")).alias("shift"), "kinds", "item_words", "written", F.expr("slice(raw, pos + 1, size)").alias("words"))
    # a repeated key with other text does not fit its windows
    fits = F.expr("size(words) = size(item_words) and forall(sequence(0, size(kinds) - 1), i -> (startswith(kinds[i], '<') and not written) or item_words[i] = words[i])")
    # both are read several times: without a cut each reading plans, and plans again, all that stands before it
    held = cut(held.where(fits).withColumn("same_words", F.expr("words = item_words")), "held")
    slots = held.select(key, "item_id", "shift", F.explode(F.arrays_zip("kinds", "item_words", "words")).alias("s")).where("startswith(s.kinds, '<')")
    values = slots.groupBy(key, "item_id", "shift", F.col("s.kinds").alias("kind"), F.col("s.item_words").alias("value")).agg(F.count_distinct("s.words").alias("n"), F.bool_and(F.expr("s.item_words = s.words")).alias("same"))
    aligned = values.groupBy(key, "item_id", "shift").agg(F.max("n").alias("most"), F.bool_and("same").alias("same"))
    kept = cut(held.select(key, "item_id", "item_pos", "size", "shift", "hash", "same_words").join(aligned, [key, "item_id", "shift"], "left").where("coalesce(most, 1) = 1"), "kept")
    verbatim = kept.groupBy(key, "item_id").agg(F.bool_and(F.coalesce("same", F.lit(True))).alias("verbatim"))
    written = kept.where("same_words").select(key, "item_id", "shift", "item_pos", "size").distinct()
    place = F.row_number().over(Window.partitionBy(key, "item_id", "shift").orderBy("item_pos"))
    runs = written.withColumn("island", F.col("item_pos") - place).groupBy(key, "item_id", "shift", "island").agg((F.count("*") + F.max("size") - 1).alias("run"))
    runs = runs.groupBy(key, "item_id").agg(F.max("run").alias("run"))
    out = covered(kept).join(verbatim, [key, "item_id"]).join(runs, [key, "item_id"], "left").withColumn("run", F.coalesce("run", F.lit(0)).cast("long"))
    out = out.where((F.col("found") >= share * F.col("windows")) | (F.col("run") >= run))
    return out.select(key, "item_id", "windows", "found", F.round(F.col("found") / F.col("windows"), 6).alias("share"), "run", "verbatim")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text leaks no item, with their own columns: each text is judged by itself, whatever its doc_id.

    Null texts stay; repeated rows stay or go together; without benchmark all stay. Documents that surely leak nothing are not shuffled.
    """
    name, mark = unused(documents, "_text"), unused(documents, "_marked")
    keyed = documents.withColumn(name, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    bad = cut(leaks(keyed.select(name, "text"), benchmark, key=name).select(name).distinct(), "leaking")
    marked = marked_by(keyed, name, bad, mark)
    return marked.where(f"not {mark}").unionByName(marked.where(mark).join(bad, name, "left_anti")).select(documents.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return leaks(docs, table(spark, sf_dir, "benchmark"))


def _sql_template(table_name: str, key: str) -> str:
    number = r"regexp_replace({}, '([0-9])[.,]([0-9])', '\1\2', 'g')"
    raw = rf"trim(regexp_replace({number.format(number.format("coalesce(text, '')"))}, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
    s = "' ' || replace(raw, ' ', '  ') || ' '"
    s = rf"regexp_replace({s}, ' [0-9][^ ]* ', ' <num> ', 'g')"
    s = rf"regexp_replace({s}, ' \p{{Lu}}[^ ]* ', ' <name> ', 'g')"
    s = f"regexp_replace({s}, ' (?:{'|'.join(NUMBER_WORDS)}) ', ' <num> ', 'g')"
    s = f"regexp_replace({s}, ' <num>  (?:{'|'.join(UNITS)}) ', ' <num>  <unit> ', 'g')"
    words = lambda c: f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ' ') END"
    return f"""(SELECT {key}, {words("raw")} AS raw, {words("tpl")} AS words FROM (SELECT {key}, raw, trim(replace({s}, '  ', ' ')) AS tpl FROM (SELECT {key}, {raw} AS raw FROM {table_name})))"""


_SQL_PLAIN = "len(list_filter(kinds, lambda w: NOT starts_with(w, '<')))"

QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL = {
    "op10_decontaminate": f"""
WITH it AS (SELECT item_id, raw, words, least(len(words), {WINDOW}) AS size FROM {_sql_template("benchmark", "item_id")} WHERE len(words) > 0),
ip AS (SELECT item_id, raw, words, size, unnest(range(0, len(words) - size + 1)) AS item_pos FROM it),
iw AS (SELECT item_id, item_pos, size, raw[item_pos + 1:item_pos + size] AS item_words, words[item_pos + 1:item_pos + size] AS kinds FROM ip),
i AS (SELECT *, CASE WHEN {_SQL_PLAIN} < {LITERALS} THEN item_words ELSE kinds END AS met, {_SQL_PLAIN} < {LITERALS} AS written FROM iw),
dt AS (SELECT doc_id, raw, words, size FROM {_sql_template("documents", "doc_id")}, (SELECT DISTINCT size FROM i) WHERE len(words) >= size),
dp AS (SELECT doc_id, raw, words, size, unnest(range(0, len(words) - size + 1)) AS pos FROM dt),
dw AS (SELECT doc_id, pos, raw[pos + 1:pos + size] AS doc_words, words[pos + 1:pos + size] AS kinds FROM dp),
d AS (SELECT *, CASE WHEN {_SQL_PLAIN} < {LITERALS} THEN doc_words ELSE kinds END AS met, {_SQL_PLAIN} < {LITERALS} AS written FROM dw),
m AS (SELECT d.doc_id, i.item_id, i.item_pos, i.size, i.met, i.written, i.kinds, pos - item_pos AS shift, item_words, doc_words FROM d JOIN i ON d.met = i.met AND d.written = i.written),
slots AS (SELECT doc_id, item_id, shift, unnest(kinds) AS kind, unnest(item_words) AS value, unnest(doc_words) AS other FROM m),
aligned AS (SELECT doc_id, item_id, shift, max(n) AS most, bool_and(same) AS same FROM
  (SELECT doc_id, item_id, shift, kind, value, count(DISTINCT other) AS n, bool_and(value = other) AS same FROM slots WHERE starts_with(kind, '<') GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT m.*, coalesce(a.same, true) AS same FROM m LEFT JOIN aligned a USING (doc_id, item_id, shift) WHERE coalesce(a.most, 1) = 1),
w AS (SELECT DISTINCT doc_id, item_id, shift, item_pos, size FROM kept WHERE item_words = doc_words),
o AS (SELECT *, item_pos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_pos) AS island FROM w),
runs AS (SELECT doc_id, item_id, max(run) AS run FROM (SELECT doc_id, item_id, shift, island, count(*) + max(size) - 1 AS run FROM o GROUP BY ALL) GROUP BY ALL),
n AS (SELECT item_id, count(DISTINCT met) AS windows FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(DISTINCT met) AS found, bool_and(same) AS verbatim FROM kept GROUP BY ALL)
SELECT c.doc_id, c.item_id, n.windows, c.found, round(c.found / n.windows, 6) AS share, coalesce(r.run, 0)::BIGINT AS run, c.verbatim
FROM c JOIN n USING (item_id) LEFT JOIN runs r USING (doc_id, item_id) WHERE c.found >= {SHARE} * n.windows OR coalesce(r.run, 0) >= {RUN}
"""
}
