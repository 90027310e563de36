"""Cleaning annotation text, splitting sentences, matching terms and dropping sentences, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the annotation text carries besides prose, in the order in which it is taken out.
BOOKKEEPING = (r"\{ECO:[^}]*\}", r"\([^()]*(?:PubMed:|ECO:|Ref\.)[^()]*\)", r"\((?:By similarity|Probable|Potential)\)", r"(?U)FUNCTION:\s*")
#: What a match of each of them holds, one or the other.
BOOKKEEPING_HOLDS = dict(zip(BOOKKEEPING, (("{ECO:",), ("PubMed:", "ECO:", "Ref."), ("(By similarity)", "(Probable)", "(Potential)"), ("FUNCTION:",)), strict=True))
#: Periods that end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "spp.", "sp.", "cf.", "approx.", "vs.", "etc.")
#: White space as ``(?U)\\s`` has it: the inside of a class, which is matched faster, and the characters.
_SPACES = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_CHARS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Own code points of the private area that stand for protected marks and for breaks.
DOT, SEMICOLON, BREAK = "\uf4d1", "\uf4d2", "\uf4d3"


def holds_private(text: Column) -> Column:
    """Whether a text holds one of the code points that stand for protected marks and breaks."""
    return text.contains(DOT) | text.contains(SEMICOLON) | text.contains(BREAK)


def guarded(text: Column) -> Column:
    """``text``, or an error if it :func:`holds_private`."""
    return F.when(holds_private(text), F.raise_error(F.lit("text holds a private code point"))).otherwise(text)


def normalised(text: Column) -> Column:
    """Null as empty, runs of white space as one space, no white space at the ends."""
    # plain characters are passed over at the first look, and most spaces stand alone
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^ -~](?<=[{_SPACES}])", " ")
    return F.trim(F.regexp_replace(spaced, "  ++", " "))


def joined_fields(*fields: Column) -> Column:
    """Fields joined by ``; ``, empty ones included, with semicolons and spaces stripped from both ends only."""
    return F.btrim(F.concat_ws("; ", *[F.coalesce(f, F.lit("")) for f in fields]), F.lit("; "))


def _without(text: Column, pattern: str) -> Column:
    """``text`` without the matches of ``pattern``; a text that holds none of the literals that a match must hold is not searched."""
    if not (held := BOOKKEEPING_HOLDS.get(pattern)):
        return F.regexp_replace(text, pattern, "")
    any_ = lambda t: reduce(or_, [t.contains(h) for h in held])
    return let(text, lambda t: F.when(any_(t), F.regexp_replace(t, pattern, "")).otherwise(t))


def clean_annotation(text: Column, patterns: Sequence[str] = BOOKKEEPING) -> Column:
    """Without bookkeeping, and without the marks and spaces that taking it out leaves behind."""
    out = F.coalesce(text, F.lit(""))
    for pattern in patterns:
        out = _without(out, pattern)
    # a gap before a mark goes, as do brackets around nothing; of a row of full stops and semicolons the first stays
    out = F.regexp_replace(normalised(out), r"[ (](?:(?<= )(?=[.;,:])|(?<=\() ?\))", "")
    out = F.regexp_replace(out, r"[.;](?<=[.;]{2})[.;]*+", "")
    return F.rtrim(F.ltrim(out, F.lit(".;,: ")))


def _mask(text: Column) -> Column:
    return F.translate(text, ".;", DOT + SEMICOLON)


def _within_brackets(text: Column) -> Column:
    """Marks inside brackets protected; an unopened bracket closes nothing. Folds over pieces between brackets, not characters."""
    pieces = F.split(text, r"(?<=[()\[\]])|(?=[()\[\]])")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        depth = F.when(piece.isin("(", "["), state["depth"] + 1).when(piece.isin(")", "]"), F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        return F.struct(depth.alias("depth"), F.concat(state["out"], F.array(F.when(state["depth"] > 0, _mask(piece)).otherwise(piece))).alias("out"))

    folded = F.aggregate(pieces, start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(text.rlike(r"[(\[][^)\]]*[.;]"), folded).otherwise(text)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _protected(text: Column) -> Column:
    """Periods of abbreviations, initials and numbers protected, in one search for periods; what stands around them decides."""
    single = "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS if a.count(".") == 1)
    around = [
        rf"(?<=(?<!\w)(?i:{single})\.)",
        # of ``i.e.g.`` the last two letters are one
        r"(?<=(?<!\w)(?i:e)\.)(?=(?i:g)\.)", r"(?<=(?<!\w)(?i:e\.g)\.)",
        r"(?<=(?<!\w)(?i:i)\.)(?=(?i:e)\.(?!(?i:g)\.))", r"(?<=(?<!\w)(?i:i\.e)\.)(?!(?i:g)\.)",
        r"(?<=\b[A-Z]\.)(?=\s+[a-z])", r"(?<=\d\.)(?=\d)",
    ]
    return F.regexp_replace(text, rf"(?U)\.(?:{'|'.join(around)})", DOT)


def sentences(text: Column) -> Column:
    """Sentences of a text: split at white space behind ``.`` or ``;``, but not behind abbreviations, initials or within brackets."""

    def parts(masked: Column) -> Column:
        # white space is left at the ends of the text only
        broken = F.btrim(F.regexp_replace(masked, rf"([.;])[{_SPACES}]+", f"$1{BREAK}"), F.lit(_SPACE_CHARS))
        restored = F.split(F.replace(F.replace(broken, F.lit(DOT), F.lit(".")), F.lit(SEMICOLON), F.lit(";")), BREAK)
        return F.filter(restored, lambda s: F.btrim(s, F.lit(" .;,:")) != "")

    return let(F.coalesce(text, F.lit("")), lambda t: let(_protected(guarded(t)), lambda m: parts(_within_brackets(m))))


def term_pattern(terms: Sequence[str]) -> str:
    """A pattern for any of the terms, longer ones before their beginnings, with a regular plural; hyphens bound words, letters do not."""
    if not terms or any(not t.strip() for t in terms):
        raise ValueError("terms must be given and none may be blank")
    # in falling order a term stands before those that it begins with
    listed = [re.escape(t) for t in sorted(set(terms), key=str.lower, reverse=True)]
    # the class of first letters, and of what may be one in another case, and plain letters before it spare most places the costly look behind
    first = "".join(sorted({re.escape(c) for t in terms for c in (t[0].lower(), t[0].upper()) if len(c) == 1 and c < "\x80"}))
    return f"(?U)(?=[{first}\\x80-\\x{{10FFFF}}])(?<![A-Za-z0-9_])(?<!\\w)(?i:({'|'.join(listed)})s?)(?!\\w)"


def matched_terms(parts: Column, terms: Sequence[str], exclusions: Sequence[str] = ()) -> Column:
    """The sorted distinct terms, as listed in lower case, that sentences match once exclusions are blanked out."""
    return _distinct_terms(F.flatten(F.transform(parts, lambda s: _found(s, terms, exclusions))))


def _distinct_terms(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(found), F.lower)))


def _found(sentence: Column, terms: Sequence[str], exclusions: Sequence[str]) -> Column:
    """What matches a term in a sentence once exclusions are blanked out. If blanking can make no match, only a sentence with one is blanked."""
    plain, pattern = F.regexp_extract_all(sentence, F.lit(term_pattern(terms)), 1), F.lit(term_pattern(terms))
    if not exclusions:
        return plain
    blanked = F.regexp_extract_all(F.regexp_replace(sentence, term_pattern(exclusions), " "), pattern, 1)
    bounded = all(re.fullmatch(r"\w(.*\w)?", x) for x in (*terms, *exclusions)) and not any(re.search(r"\W\W", t) for t in terms)
    return let(plain, lambda found: F.when(F.size(found) == 0, found).otherwise(blanked)) if bounded else blanked


def ablated(parts: Column, terms: Sequence[str], exclusions: Sequence[str] = ()) -> Column:
    """struct(sentences, kept, removed, matched_terms, characters_before, characters_after) of an array of sentences."""
    of = lambda hits, hit: F.transform(F.filter(hits, lambda x: (F.size(x["found"]) > 0) == F.lit(hit)), lambda x: x["s"])
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + F.length(s))

    def whole(hits: Column, kept: Column) -> Column:
        found = _distinct_terms(F.flatten(F.transform(hits, lambda x: x["found"])))
        return F.struct(F.transform(hits, lambda x: x["s"]).alias("sentences"), kept.alias("kept"), of(hits, True).alias("removed"), found.alias("matched_terms"), size(F.transform(hits, lambda x: x["s"])).alias("characters_before"), size(kept).alias("characters_after"))

    hits = F.transform(parts, lambda s: F.struct(s.alias("s"), _found(s, terms, exclusions).alias("found")))
    return let(hits, lambda h: let(of(h, False), lambda kept: whole(h, kept)))


def random_dropped(parts: Column, key: Column, seed: Column, count: Column) -> Column:
    """``parts`` without exactly ``count`` of them, the first by hash of seed, key and place; more than there are is an error.

    The hashes are worked out once, and a part goes if its own is not above the last one that goes: linear in the parts but for the sort.
    """
    order = F.transform(parts, lambda _, i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    paired = lambda hashes: F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.get(hashes, i).alias("o")))
    left = lambda hashes: let(F.get(F.array_sort(hashes), count - 1), lambda last: F.transform(F.filter(paired(hashes), lambda x: (count == 0) | (x["o"] > last)), lambda x: x["s"]))
    return F.when(count > F.size(parts), F.raise_error(F.lit("more sentences are to go than there are"))).otherwise(let(order, left))


def substitutions(variant: Column, one_based: bool) -> Column:
    """array<struct(pos, wt, mut)> of a text such as ``A24G:L56P``; null where it is malformed. ``pos`` is zero-based."""
    item = r"[ACDEFGHIKLMNPQRSTVWY]\d+[ACDEFGHIKLMNPQRSTVWY]"
    parsed = F.transform(
        F.split(variant, ":"),
        lambda s: F.struct((F.substring(s, 2, 1000).substr(F.lit(1), F.length(s) - 2).cast("int") - int(one_based)).alias("pos"), F.substring(s, 1, 1).alias("wt"), F.substring(s, -1, 1).alias("mut")),
    )
    good = variant.rlike(rf"^{item}(:{item})*$")
    return F.when(good & ~F.exists(F.when(good, parsed), lambda x: x["pos"] < 0), parsed)
