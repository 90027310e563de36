import re

import corpus_pipeline as P
from plumbline.llm.common import cut
from tests.llm.test_pii import plain

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = rows.keys() - after.keys()
        assert after.keys() <= rows.keys()
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in after for i in good) > 0.98 * len(good)
            assert sum(i in gone for i, q in labels.items() if q == 0) > 0.8 * sum(q == 0 for q in labels.values())
        elif name == "near_duplicates":
            assert len(set(after.values())) == len(after) and gone
        elif name == "decontamination":
            assert {i for i, t in rows.items() if any(x in t for x in items)} <= gone
        else:
            assert not gone and not any(plain(t) for t in after.values())
            assert all(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", after[i]) == t or after[i] != t for i, t in rows.items())
        rows = after
    out = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == rows.keys()
    assert {r.doc_id for r in P.run(spark, SF).collect()} == rows.keys()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, one id twice, no ids, clashing columns, and tables without rows."""
    kind = "doc_id long, text string, key string, stats int, _text string, marked double, _cell long, _key int"
    good = "Plain words that make a sentence number {} here, and it goes on for a while with other words. "
    rows = [(i, good.format(i) * 3, "k", 1, "t", 0.5, 2, 3) for i in range(12)]
    rows += [(1, good.format(1) * 3, "k", 1, "t", 0.5, 2, 3)] * 2 + [(2, good.format(77) * 2, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None), (None, good.format(3) * 3, "k", 1, "t", 0.5, 2, 3), (20, None, "k", 1, "t", 0.5, 2, 3), (21, "", "k", 1, "t", 0.5, 2, 3)]
    rows += [(22, "word " * 60_000 + "jane@site.org", "k", 1, "t", 0.5, 2, 3), (23, "Call +1 377 555 02 71 or jane.doe@host.example.org now", "k", 1, "t", 0.5, 2, 3)]
    leak = "why does a bridge over a wide river bend when the sun is on it"
    rows += [(24, f"Some words and then {leak} and more.", "k", 1, "t", 0.5, 2, 3)]
    docs = spark.createDataFrame(rows, kind)
    sf = str(tmp_path)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    sizes = []
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0
        docs = cut(stage(spark, docs, sf), "odd")
        assert docs.dtypes == [tuple(f.split()) for f in kind.replace("long", "bigint").split(", ")]
        sizes.append(docs.count())
    out = docs.collect()
    ids = sorted(r.doc_id for r in out if r.doc_id is not None)
    assert sizes[0] == len(rows) and ids == [*range(3), 2, *range(3, 12), 20, 21, 22, 23] and sum(r.doc_id is None for r in out) == 1
    held = {r.doc_id: r.text for r in out if r.doc_id in (20, 21, 22, 23)}
    assert held[20] is None and held[21] == "" and held[22].endswith("[EMAIL]") and "[PHONE]" in held[23] and "[EMAIL]" in held[23]
    given = {tuple(r)[2:] for r in rows}
    assert {tuple(r)[2:] for r in out} <= given and len({tuple(r)[2:] for r in out}) == 2
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(out) and {r.n_tokens for r in last.where("doc_id in (20, 21)").collect()} == {0}
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
