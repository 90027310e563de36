"""Personal data by candidate gradient boosting (operator 6).

High-recall generators propose overlapping spans for each kind. Boosted trees score a candidate from its format and
its context, a threshold calibrated per kind selects spans, and the best-scored of overlapping ones stay. Candidates
that meet the base rules of a kind (address grammar, octet range, Luhn digits, international prefix) are always kept.

What cannot be of a kind in any form (too few digits, a date, octets over 255, the end of a sentence within an address) is
no candidate. Labels come from how a span was made, by no rule that a feature repeats: positives are base spans written
otherwise where they stand, an ``@`` spelt out, a number in national form, card digits regrouped; negatives are decoys,
plain numbers of the same digits such as lists of years, ranges of pages, tables, dates and citations, and words around
an ``(at)``. Candidates of the corpus itself have no label. ``SEEDS`` adds a few texts, so that small tables have both.
Features are binned, so that Spark counts positives and negatives of every distinct feature vector, and the trees are
fitted on those counts, which are bounded by the bins. Both labels of a kind weigh ``WEIGHT`` whatever their number. A
fifth of the texts, by hash, is held out of the fit: the thresholds are calibrated on it, and :func:`measured` gives the
precision and recall of the selection there.

Null texts count as empty. A text without spans gives zero counts and empty strings. Positions are code points, end
exclusive. Rows with a null doc_id and repeated rows give a row each; equal texts give equal rows; an empty table gives
none. Columns of any name are left behind where spans are found, and kept as they are where texts are redacted. Runs of
any length are read in linear time.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts_of, utf8

KINDS = ("email", "ip", "card", "phone")
#: The least share of the positives of a kind that the calibrated threshold lets through.
RECALL = 0.98
#: What the positives of a kind weigh in the fit, and what its negatives weigh.
WEIGHT = 1000.0
TREES, DEPTH, RATE = 40, 3, 0.3
LEAST_SCORE = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: High-recall generators beside the base rules: spelt-out addresses, national numbers, grouped digits, partial quads.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,}+)+")),
    # an address that ends where a sentence does, too
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]{2,}+)+")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|0|00)[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: each ``@`` is extended to the left over its run, never past the last address."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _WORD_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base rules, each leftmost and without overlap within its kind."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _LOOSE:
        if digits if kind != "email" else "at)" in text or "at]" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if digits:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)] if "+" in text else []
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text)]
    return out


#: The number of bins of each feature of a candidate.
BINS = (4, 6, 6, 4, 4, 4, 3, 4, 2, 2, 3)
_SENTENCE = re.compile(r"(?<! )\. | \.(?! )")
_LAST_LABEL = re.compile(r"[A-Za-z0-9-]+$")
_DATE = re.compile(r"[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}([./-])[0-9]{2}\2[0-9]{2}")
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
_SPELT = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("[at]", "."), (" (at) ", " . "))
#: Texts whose base spans are labelled like those of the corpus.
SEEDS = (
    "Write to jane.doe@host.example.org or call +44 (377) 555-0271 or +1 377 555 02 71, card 4111 1111 1111 1111.",
    "jo@site.org, +4930123456789; 5500000000000004",
    "pay 378282246310005 or 6011-1111-1111-1117 by noon, ring +33 6 12 34 56 78, mail a.b@c-d.co.uk",
)


def broken(span: str) -> bool:
    """Whether a spelt-out address holds the end of a sentence, or ends in a number."""
    return _SENTENCE.search(span) is not None or not any(c.isalpha() for c in _LAST_LABEL.search(span)[0])


def masked(kind: str, span: str) -> list[str]:
    """Other forms of a base span that the generators of its kind are to find."""
    d = _digits(span)
    if kind == "email":
        local, host = span.split("@")
        return [local + at + host.replace(".", dot) for at, dot in _SPELT]
    if kind == "phone":
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return [f"({a}) {b}-{c}", f"(0{a}) {b}-{c}", f"0{a} {b} {c}", f"0{a}-{b}-{c}", f"0{a}.{b}.{c}", f"0{a[1:]} {b} {c[:3]}", f"0{a} {b} {c[:2]} {c[2:]}", f"00{d[:2]} {a} {b} {c}"]
    if kind == "card":  # the features do not tell which digits: mistyped ones look alike
        return [d, *(sep.join((d[:4], d[4:8], d[8:12], d[12:])) for sep in (" ", "-") if len(d) == 16)]
    return []


def impossible(kind: str, span: str) -> bool:
    """Whether a candidate that is no base span cannot be of its kind in another form either."""
    if kind == "email":
        return broken(span)
    n = len(_digits(span))
    if kind == "phone":
        return n < 7 or n > 15 or _DATE.fullmatch(span) is not None
    return kind == "ip" or n < 14 or n > 19


def decoys(kind: str, span: str) -> list[str]:
    """Spans of the form that the generators of a kind propose, and of the digits of a base span, that are not of the kind."""
    if kind == "email":
        local, host = span.split("@")
        first, *more = [w for w in re.split(r"[^A-Za-z]+", f"{local} {host}") if len(w) > 1] or ["look"]
        last = (more or ["home"])[-1]
        return [f"{first} (at) {last}.{w}" for w in ("Then", "The", "Nobody")] + [f"{first} (at) {last}.{last.capitalize()} (dot) Next"]
    if kind == "ip":
        return []
    d = (_digits(span) * 6)[:48]
    pairs, threes, fours = ([d[i : i + n] for i in range(0, 48, n)] for n in (2, 3, 4))
    years = [f"{19 + int(p[0]) % 2}{p[1:]}" for p in threes]
    if kind == "card":
        lists = [" ".join(years[:k]) for k in (4, 5)] + ["-".join(years[:4]), f"{years[0]}-{years[1]} {years[2]}-{years[3]}", " ".join(pairs[:7]), " ".join(pairs[:8]), "-".join(pairs[:8]), " ".join(threes[:5]), " ".join(threes[:6]), " ".join(d[:14]), " ".join(d[:16]), "-".join(d[:15])]
        return [*lists, f"{years[0]}-{pairs[0]}-{pairs[1]} {years[1]}-{pairs[2]}-{pairs[3]}", f"{threes[0]}-{threes[1]} {threes[2]}-{threes[3]} {threes[4]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]} {fours[3]}", f"{pairs[0]} {fours[0]} {pairs[1]} {fours[1]} {pairs[2]}", f"{d[0]} {threes[1]} {threes[2]} {d[5]} {threes[3]} {threes[4]}"]
    return [f"({years[0]}) {threes[0]}-{threes[1]}", f"({years[0]}) {pairs[0]} {threes[0]}-{threes[1]}", f"0{threes[0]}.0{threes[1]}", f"0{pairs[0]}-0{pairs[1]}-0{pairs[2]}", f"00{pairs[0]} 00{pairs[1]} 00{pairs[2]}", f"0{threes[0]} 0{threes[1]} 0{threes[2]}", f"({pairs[0]}) {years[0]}-{years[1]}"]


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Binned format and context: kind, digits, length, grouping (addresses: their end), separators, letters, left, right, cue, years."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    groups = re.findall(r"[0-9]+", span)
    before, after = text[start - 1 : start], text[end : end + 1]
    around = text[max(0, start - 24) : start].lower()
    cue = 1 if re.search(r"(?:tel|phone|call|fax|mail|card|visa|ip|host)\W*$", around) else 0
    left = 0 if not before else 1 if before.isspace() else 2 if before.isalnum() else 3
    sizes = [len(g) for g in groups]
    if kind == "email":
        label = _LAST_LABEL.search(span)
        group = int(label is None or not (label[0].isalpha() and label[0].islower()))
    elif len(sizes) < 2:
        group = 0
    elif set(sizes[:-1]) == {4} and sizes[-1] <= 4 or sizes[:2] == [4, 6]:
        group = 1
    else:
        group = 2 if len(set(sizes)) == 1 else 3
    return (
        KINDS.index(kind),
        int(np.searchsorted((1, 4, 10, 13, 16), digits, "right")),
        int(np.searchsorted((8, 12, 16, 20, 30), end - start, "right")),
        group,
        min(3, sum(c in " ()." for c in span)),
        min(3, sum(c in "-+" for c in span)),
        0 if not any(c.isalpha() for c in span) else 2 if "@" in span else 1,
        left,
        int(after.isalnum()),
        cue,
        min(2, sum(_YEAR.fullmatch(g) is not None for g in groups)),
    )


def _code(vector: tuple[int, ...]) -> int:
    out = 0
    for v, n in zip(vector, BINS, strict=True):
        out = out * n + min(v, n - 1)
    return out


def _vectors(codes: np.ndarray) -> np.ndarray:
    out = []
    for n in reversed(BINS):
        out.append(codes % n)
        codes = codes // n
    return np.column_stack(out[::-1])


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[tuple[str, int, int], int]]]:
    """The base spans; and every candidate, base ones included, with the code of its features. What cannot be of its kind is none."""
    base = base_spans(text)
    held = set(base)
    spans = dict.fromkeys([*base, *(s for s in loose_spans(text) if s in held or not impossible(s[0], text[s[1] : s[2]]))])
    return base, [(s, _code(features(text, *s))) for s in spans]


def labelled(text: str) -> list[tuple[int, bool]]:
    """The codes of made spans in the place of the base spans of a text, and whether they are of the kind."""
    out = []
    for kind, start, end in base_spans(text):
        before, after = text[max(0, start - 24) : start], text[end : end + 1]
        for forms, positive in ((masked(kind, text[start:end]), True), (decoys(kind, text[start:end]), False)):
            # a decoy stands where any number may stand: half of them keep the words before
            for k, form in enumerate(forms):
                ahead = before if positive or k % 2 else " "
                changed, span = ahead + form + after, (kind, len(ahead), len(ahead) + len(form))
                if span in loose_spans(changed) and not impossible(kind, form):
                    out.append((_code(features(changed, *span)), positive))
    return out


def _rows(batch: pa.RecordBatch) -> list[int]:
    """The rows of a batch that hold a digit, ``@`` or a spelt-out ``at``; others have no candidates."""
    data, offsets = utf8(batch.column(1))
    mark = np.zeros(256, bool)
    mark[[*range(48, 58), ord("@"), ord("["), ord("(")]] = True
    counts = np.concatenate([[0], np.cumsum(mark[data])])[offsets]
    return np.flatnonzero(np.diff(counts)).tolist()


HELD_OUT = 5


def candidate_counts(docs: DataFrame) -> DataFrame:
    """code, held, n, positive: labelled candidates by feature vector over all documents, apart for texts that are held out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[tuple[int, bool], list[int]] = {}
        for i in _rows(batch):
            text = batch.column(1)[i].as_py()
            held = zlib.crc32(text.encode()) % HELD_OUT == 0
            for code, positive in labelled(text):
                cell = n.setdefault((code, held), [0, 0])
                cell[0] += 1
                cell[1] += positive
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in n], pa.int64()), pa.array([h for _, h in n], pa.bool_()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], names=["code", "held", "n", "positive"]
        )

    found = map_batches(texts_of(docs), run, "code long, held boolean, n long, positive long")
    return found.groupBy("code", "held").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def _grow(x: np.ndarray, grad: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
    """A regression tree on binned columns: (feature, cut, left, right) or a leaf's value; ties go to the first split."""
    g, w = grad[rows].sum(), weight[rows].sum()
    best = (1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            gs, ws = (np.bincount(x[rows, f], v[rows], BINS[f]).cumsum()[:-1] for v in (grad, weight))
            gain = gs**2 / (ws + 1) + (g - gs) ** 2 / (w - ws + 1) - g**2 / (w + 1)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        return (g / (w + 1),)
    f, c = best[1]
    left = x[rows, f] <= c
    return (f, c, _grow(x, grad, weight, rows[left], depth - 1), _grow(x, grad, weight, rows[~left], depth - 1))


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, c, a, b = tree
    return np.where(x[:, f] <= c, _apply(a, x), _apply(b, x))


def _weighed(cells: dict[int, list[float]], codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negatives and positives of each code, so that both labels of a kind weigh WEIGHT."""
    neg, pos = np.array([cells.get(c, (0.0, 0.0)) for c in codes.tolist()], float).T
    for k in range(len(KINDS)):
        own = kinds == k
        for label in (neg, pos):
            label[own] *= WEIGHT / max(label[own].sum(), 1e-9)
    return neg, pos


def fit(counts: list[tuple[int, bool, int, int]]) -> dict:
    """Boosted trees on weighed feature vectors (logistic loss), and a threshold for each kind from what is held out."""
    fitted: dict[int, list[float]] = {}
    held: dict[int, list[float]] = {}
    seeds = [(code, 1, int(positive)) for text in SEEDS for code, positive in labelled(text)]
    for cells, rows in ((fitted, [*((c, n, p) for c, h, n, p in counts if not h), *seeds]), (held, [*((c, n, p) for c, h, n, p in counts if h), *seeds])):
        for code, n, pos in rows:
            cell = cells.setdefault(code, [0.0, 0.0])
            cell[0] += n - pos
            cell[1] += pos
    codes = np.array(sorted({*fitted, *held}))
    x = _vectors(codes)
    neg, pos = _weighed(fitted, codes, x[:, 0])
    n, start = neg + pos, float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
    f, trees = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(x, pos - n * p, n * p * (1 - p), np.arange(len(x)), DEPTH)
        trees.append(tree)
        f += RATE * np.clip(_apply(tree, x), -4, 4)
    p = 1 / (1 + np.exp(-f))
    neg, pos = _weighed(held, codes, x[:, 0])
    return {"trees": trees, "start": start, "threshold": [_threshold(p[own], pos[own], neg[own]) for own in (x[:, 0] == k for k in range(len(KINDS)))]}


def measured(counts: list[tuple[int, bool, int, int]], model: dict) -> dict[str, tuple[int, int, int]]:
    """Of each kind's candidates that are held out: selected ones that are of the kind, selected ones in all, and all that are of the kind."""
    rows = [(c, n, p) for c, held, n, p in counts if held]
    out = {k: (0, 0, 0) for k in KINDS}
    if rows:
        codes, n, pos = (np.array(x) for x in zip(*rows, strict=True))
        kinds = _vectors(codes)[:, 0]
        taken = chances(model, codes) >= np.array(model["threshold"])[kinds]
        for k, name in enumerate(KINDS):
            own = kinds == k
            out[name] = (int(pos[own & taken].sum()), int(n[own & taken].sum()), int(pos[own].sum()))
    return out


def _threshold(p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """Midway below the chance that parts the labels best and lets RECALL of the positives through; at least LEAST_SCORE."""
    if not pos.sum():
        return 1.0
    levels, at = np.unique(-p, return_inverse=True)
    passed, wrong = (np.cumsum(np.bincount(at, v, len(levels))) for v in (pos, neg))
    best = int(np.argmax(np.where(passed >= RECALL * passed[-1], passed - wrong, -np.inf)))
    below = -levels[best + 1] if best + 1 < len(levels) else 0.0
    return max(LEAST_SCORE, float((below - levels[best]) / 2))


def chances(model: dict, codes: np.ndarray) -> np.ndarray:
    x = _vectors(codes)
    return 1 / (1 + np.exp(-(model["start"] + RATE * sum((np.clip(_apply(t, x), -4, 4) for t in model["trees"]), np.zeros(len(x))))))


def select(base: list, found: list, chance: dict[int, float], threshold: list[float]) -> list[tuple[str, int, int]]:
    """All base spans, and candidates over their kind's threshold that overlap no better one."""
    taken, order = sorted(base, key=lambda s: s[1]), {k: i for i, k in enumerate(KINDS)}
    out, held = list(taken), set(base)
    more = sorted(((-chance[c], s[1], order[s[0]], s) for s, c in found if s not in held and chance[c] >= threshold[order[s[0]]]))
    for *_, s in more:
        if all(s[2] <= o[1] or o[2] <= s[1] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def train(docs: DataFrame) -> dict:
    """The model of a corpus; the counts it is fitted on are at most twice the product of BINS."""
    return fit([tuple(r) for r in candidate_counts(docs).select("code", "held", "n", "positive").collect()])


def _scan(model: dict):
    chance: dict[int, float] = {}

    def spans(text: str) -> tuple[list, list]:
        base, found = candidates(text)
        if missing := [c for _, c in found if c not in chance]:
            chance.update(zip(missing, chances(model, np.array(missing)).tolist(), strict=True))
        return base, select(base, found, chance, model["threshold"])

    return spans


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    model = model or train(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, rows = _scan(model), set(_rows(batch))
        got = [spans(batch.column(1)[i].as_py()) if i in rows else ([], []) for i in range(batch.num_rows)]
        order = {k: i for i, k in enumerate(KINDS)}
        as_dicts = lambda found: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(found, key=lambda s: (s[1], order[s[0]]))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_dicts(b) for b, _ in got], kind), pa.array([as_dicts(s) for _, s in got], kind)], names=["doc_id", "base", "spans"])

    struct = "array<struct<kind: string, start: long, end: long>>"
    return map_batches(texts_of(docs), run, f"doc_id long, base {struct}, spans {struct}")


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The documents with every selected span replaced by ``[KIND]``; other columns as they are, ``n_chars`` renewed if there."""
    model = model or train(docs)
    small = docs.schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = _scan(model), batch.column("text").to_pylist()
        for i, text in enumerate(texts):
            if text:
                out, at = [], 0
                for kind, start, end in spans(text)[1]:
                    if end > at:
                        out += [text[at:start], f"[{kind.upper()}]"] if start >= at else []
                        at = end
                if out:
                    texts[i] = "".join([*out, text[at:]])
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in small]
        return pa.RecordBatch.from_arrays(columns, names=small)

    out = map_batches(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in small else out


def find_digests(docs: DataFrame) -> DataFrame:
    """The counts of base spans by kind, their digest, and all spans as a string."""
    found = find(docs)
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
