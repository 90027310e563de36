import random

import duckdb
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as D

ITEM = "A farmer named Oscar sells 12 baskets of ripe apples for 3 dollars each and then gives 12 baskets to a market near the river."
NEW = "A farmer named Bertha sells 40 baskets of ripe apples for 7 dollars each and then gives 40 baskets to a market near the river."
MIXED = "A farmer named Bertha sells 40 baskets of ripe apples for 7 dollars each and then gives 55 baskets to a market near the river."


def rows(spark):
    docs = [
        (1, "Here: " + ITEM + " The end follows with other words."),
        (2, "intro words " + NEW + " more words"),
        (3, "intro words " + MIXED),
        (4, "nothing of the kind stands in this text, only plain words without any question at all."),
        (5, None), (6, ""), (7, ITEM), (7, ITEM), (8, "word " * 20_000),
    ]
    items = [(0, ITEM), (1, None), (2, ""), (3, "Too Short"), (4, "another plain item about rivers that nobody has copied into any text so far")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("item_id", F.lit(5)), spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark):
    docs, items = rows(spark)
    out = {(r.doc_id, r.item_id): r for r in D.leaks(docs, items).collect()}
    assert set(out) == {(1, 0), (2, 0), (7, 0)}
    assert out[1, 0].verbatim and out[7, 0].share == 1 and not out[2, 0].verbatim
    kept = [r.doc_id for r in D.without_leaks(docs, items).collect()]
    assert sorted(kept) == [3, 4, 5, 6, 8]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_short_items_capitals_and_excerpts(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "walks", "under", "green", "often", "light", "door"]) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n))
    long_item, short, capitals = prose(300), "why do rivers bend here", "NAME ALL FIVE GREAT LAKES OF THE NORTH BY SIZE 1 2 3"
    items = spark.createDataFrame([(1, long_item), (2, short), (3, capitals), (4, "One 2 Three")], "item_id long, text string")
    excerpt = " ".join(long_item.split()[100:130])
    docs = [
        (1, prose(40) + " " + excerpt + " " + prose(40)), (2, prose(30) + " Then: " + short + "? " + prose(9)), (3, prose(20) + " " + capitals + " " + prose(20)),
        (4, prose(60)), (5, "NAME ALL SIX SMALL PONDS OF THE SOUTH BY SIZE 1 2 3 and so on it goes here"), (6, short), (None, capitals), (7, " ".join(long_item.split()[100:108])),
        (8, prose(3) + " One 2 Three " + prose(3)), (8, prose(12)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in D.leaks(df, items).collect()}
    assert set(out) == {(1, 1), (2, 2), (3, 3), (6, 2), (8, 4)}
    assert out[1, 1].run == 30 and out[1, 1].share < 0.5 and out[2, 2].run == 5 and out[3, 3].verbatim
    assert sorted(r.doc_id for r in D.without_leaks(df, items).collect()) == [4, 5, 7, 8]
    assert D.without_leaks(df, items.limit(0)).count() == len(docs) and D.without_leaks(df.limit(0), items).count() == 0
    repeated = df.where("doc_id = 4").unionByName(df.where("doc_id = 4")).unionByName(spark.createDataFrame([(None, None)], df.schema))
    assert D.without_leaks(repeated, items).count() == 3


def test_as_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
        want = sorted(con.execute(f"select doc_id, item_id, windows, found, share, run, verbatim from ({D.SQL['op10_decontaminate']})").fetchall())
        assert sorted(tuple(r) for r in D.op10_decontaminate(spark, path).collect()) == want
    assert len(want) > 5
    planted = con.execute("select distinct d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)").fetchall()
    assert {(a, b) for a, b, *_ in want} >= set(planted)


def test_shared_stem_makes_no_pairs(spark, monkeypatch):
    """400 items and 2,000 documents share a stem of 12 words: the documents' windows are a few rows each, and no pair is made."""
    stem = "which of the following is the best answer to this question here"
    rng = random.Random(8)
    tail = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    tails = [tail(14) for _ in range(400)]
    items = spark.createDataFrame([(i, f"{stem} {t}") for i, t in enumerate(tails)], "item_id long, text string")
    docs = [(i, f"{tail(5)} {stem} {tail(9)}") for i in range(2000)] + [(5000 + i, f"{tail(3)} {stem} {tails[i]} {tail(3)}") for i in range(3)]
    written, cut = {}, D.cut

    def noted(df, label="cut"):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(D, "cut", noted)
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5000 + i, i) for i in range(3)]
    assert written["met"] <= 5 * 2003 + 3 * 15 and written["pairs"] <= 10 and written["matches"] <= 200


def test_telling_windows_lose_no_pair(spark):
    """Against every pair: items with shared and repeated windows, all shares and runs."""
    rng = random.Random(3)
    words = [f"v{a}{b}" for a in "abcd" for b in "klmn"]
    items = [(i, " ".join(rng.choices(words[:6], k=rng.choice([3, 8, 14, 20])))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            parts += own[a : a + rng.randint(1, 20)] + rng.choices(words, k=rng.randint(0, 3))
        docs.append((d, " ".join(parts)))

    def plain(share, run):
        out = set()
        for d, text in docs:
            t = text.split()
            for i, item in items:
                w = item.split()
                n = min(8, len(w))
                has = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
                wins = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
                long = any(tuple(t[x : x + run]) == tuple(w[y : y + run]) for x in range(len(t) - run + 1) for y in range(len(w) - run + 1)) if len(w) >= run else False
                if len({x for x in wins if x in has}) >= share * len(set(wins)) or long:
                    out.add((d, i))
        return out

    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for share, run in ((0.5, 13), (1.0, 9), (0.2, 40)):
        assert {(r.doc_id, r.item_id) for r in D.leaks(frame, asked, share, run).collect()} == plain(share, run)


def test_windows_put_no_arrays_together(spark):
    """A window reads its words where they are; the long text gives each of its windows."""
    made = rows(spark)
    found = D.windows(made[0] if isinstance(made, tuple) else made, "doc_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "slice(" not in plan
    assert found.where("doc_id = 8").agg(F.count("*"), F.max("pos")).first()[:] == (20_000 - D.WINDOW + 1, 20_000 - D.WINDOW)


def test_the_last_plan_is_short(spark):
    """What is read several times is written before: a plan that repeats it took hundreds of MB of the driver while it was planned again and again."""
    docs, items = rows(spark)
    plan = D.leaks(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and len(plan) < 20_000
