import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import ablation as A
from plumbline.operators.gates import GateError


def one(spark, column, **values):
    kinds = {"text": "string", "n": "int", "key": "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("One. Two; three.", ["One.", "Two;", "three."]),
        ("Acts, e.g. in yeast. I.E. here", ["Acts, e.g. in yeast.", "I.E. here"]),
        ("Lives on B. mori and feeds. Next.", ["Lives on B. mori and feeds.", "Next."]),
        ("Sits beside KOLF. it stays", ["Sits beside KOLF.", "it stays"]),
        ("Rises by 1.5 fold. Falls.", ["Rises by 1.5 fold.", "Falls."]),
        ("Cuts (EC 1.1; [see. this]; EC 2.2). Ends", ["Cuts (EC 1.1; [see. this]; EC 2.2).", "Ends"]),
        ("Stray ) here. Then (open. never closed. end", ["Stray ) here.", "Then (open. never closed. end"]),
        ("No final mark", ["No final mark"]),
        (" . ; , ", []),
        ("", []),
        (None, []),
        ("uses vs. that, approx. three spp. found. Done", ["uses vs. that, approx. three spp. found.", "Done"]),
        ("reetc. Next", ["reetc.", "Next"]),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, X.sentences(F.col("text")), text=text) == expected


def test_private_code_points_are_an_error(spark):
    with pytest.raises(PySparkException):
        one(spark, X.sentences(F.col("text")), text=f"a{X.DOT}b")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("FUNCTION: Binds it {ECO:0000269|PubMed:1}. .; FUNCTION: More (PubMed:2, PubMed:3).", "Binds it. More."),
        ("Seen (By similarity). As PubMed:77 has it, (other note) [Form 2]: stays.", "Seen. As PubMed:77 has it, (other note) [Form 2]: stays."),
        ("Seen (see PubMed:9) here ; there ( ).", "Seen here; there ."),
        ("; . , leading", "leading"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean(spark, text, expected):
    assert one(spark, X.clean_annotation(F.col("text")), text=text) == expected


def test_terms(spark):
    pattern = X.term_pattern(["nuclear", "trans-golgi network", "golgi"])
    found = lambda t: one(spark, F.regexp_extract_all(F.col("text"), F.lit(pattern), 1), text=t)
    assert found("Trans-Golgi networks and trans-Golgi") == ["Trans-Golgi network", "Golgi"]
    assert found("perinuclear cafénuclear nuclears NUCLEAR-like") == ["nuclear", "NUCLEAR"]
    with pytest.raises(ValueError):
        X.term_pattern([])
    with pytest.raises(ValueError):
        X.term_pattern(["x", " "])


def test_exclusions_must_explain_all_matches(spark):
    parts = X.sentences(F.col("text"))
    a = one(spark, X.ablated(parts, ["nucleus", "nuclear"], ["nuclear receptor"]), text="A nuclear receptor. The nuclear receptor stays in the nucleus. Plain.")
    assert a.kept == ["A nuclear receptor.", "Plain."] and a.removed == ["The nuclear receptor stays in the nucleus."] and a.matched_terms == ["nucleus"]
    assert a.characters_before == sum(map(len, a.sentences)) and a.characters_after == sum(map(len, a.kept))


def test_random_control(spark):
    parts = X.sentences(F.col("text"))
    text = "A one. B two. C three. D four."
    drop = lambda n, seed=1, key="k": one(spark, X.random_dropped(parts, F.col("key"), F.lit(seed), F.col("n")), text=text, key=key, n=n)
    assert drop(0) == ["A one.", "B two.", "C three.", "D four."] and drop(4) == [] and len(drop(3)) == 1
    assert drop(2) == drop(2) and len({tuple(drop(2, s)) for s in range(8)}) > 1
    with pytest.raises(PySparkException):
        drop(5)


def test_substitutions(spark):
    parse = lambda t, one_based=True: one(spark, X.substitutions(F.col("text"), one_based), text=t)
    assert [tuple(s) for s in parse("A24G:L56P")] == [(23, "A", "G"), (55, "L", "P")]
    assert [tuple(s) for s in parse("A0G", False)] == [(0, "A", "G")]
    assert all(parse(t) is None for t in ("A0G", "B1A", "A1", "1AG", "", "A1G:", "AxG"))


def test_joined_fields(spark):
    df = spark.createDataFrame([("a", None, "", "b"), (None, "", "c", None)], "w string, x string, y string, z string")
    assert [r.x for r in df.select(X.joined_fields(*map(F.col, "wxyz")).alias("x")).collect()] == ["a; ; ; b", "c"]


def test_lexicon_gates():
    with pytest.raises(GateError):
        A.Lexicon("1", {"g": ("a",)}, sentinels=("a",))
    with pytest.raises(GateError):
        A.Lexicon("1", {"g": ("a",)}, classes=("h",))


def test_summary_and_zero_terms(spark):
    lexicon = A.Lexicon("1", {"g": ("alpha", "beta")})
    df = spark.createDataFrame([(1, "x", "Alpha here. Beta too."), (2, "x", "Alpha here. Plain words."), (3, "y", "Plain."), (4, "y", None)], "id long, g string, t string")
    out = A.ablate(df, "t", lexicon)
    totals, groups, terms = A.ablation_summary(out, "g")
    r = totals.first()
    assert (r.documents, r.trimmed, r.emptied, r.sentences, r.sentences_removed, r.undefined_retention) == (4, 2, 1, 5, 3, 1)
    assert {x.term: x.documents for x in terms.collect()} == {"alpha": 2, "beta": 1}
    assert A.retention_gate(out).select("id").first().id == 4
    assert {x.term: x.n for x in A.term_mentions(df, F.col("t"), ["alpha", "gamma"]).collect()} == {"alpha": 2, "gamma": 0}
    assert A.untouched_faults(out).count() == 0
    assert {x["kind"] for x in lexicon.frame(spark).collect()} == {"term"}


def test_large_inputs_are_worked_on_in_pieces(spark, tmp_path, monkeypatch):
    """A file that is one split becomes as many tasks as its size asks for, and every row stays."""
    from plumbline.functions import layout

    monkeypatch.setattr(layout, "PIECE", 2000)
    spark.range(3000).selectExpr("id", "concat('It came from ', md5(string(id)), '. Then it left.') as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    done = A.ablate(df, "text", A.Lexicon("1", {"g": ("from",)}))
    assert done.rdd.getNumPartitions() >= 20 and df.rdd.getNumPartitions() < 5
    assert done.agg(F.count_distinct("id"), F.sum(F.size("removed")), F.sum(F.size("kept"))).first()[:] == (3000, 3000, 3000)


def test_neighbouring_marks(spark):
    """Abbreviations that share letters, white space of all kinds, terms that an exclusion leaves."""
    text = "As i.e.g. and I.E. so　 on\x85\n( ) end .. Sp. One. B. c 1.5; x"
    row = spark.createDataFrame([(text,)], "text string").select(X.sentences(X.clean_annotation(F.col("text"))).alias("s"), X.matched_terms(F.array(F.lit("The cell-pore Cells"), F.lit("pore forming")), ("cell", "pore"), ("pore forming",)).alias("m")).first()
    assert row.s == ["As i.e.g. and I.E. so on  end.", "Sp. One.", "B. c 1.5;", "x"] and row.m == ["cell", "pore"]
