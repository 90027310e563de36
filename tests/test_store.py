"""The vector store: commits, misses, two writers, compaction; ordered fingerprints."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import features as E
from plumbline.operators import store as V
from plumbline.operators.gates import GateError


def encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}/store"


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "id long, t string, part string, version int")


def vectors(df):
    return {r.id: (None if r.vec is None else tuple(r.vec)) for r in df.collect()}


def test_only_misses_are_encoded(spark, at):
    store, spec = V.VectorStore(spark, at, 4), E.spec_text({"encoder": "n", "batch_size": 8})
    encode = V.by_encoder("t", encoder, 2)
    first = items(spark, ["aa", "b", "aa", None, " "])
    assert vectors(store.read_through(first, "t", spec, encode)) == {0: (2, 1), 1: (1, 1), 2: (2, 1), 3: (0, 0), 4: (0, 0)}
    assert store.head()["rows"] == 4  # aa, b, the empty one (of the null) and the blank one
    more = items(spark, ["aa", "ccc", "b"])
    out = store.read_through(more, "t", spec, encode)
    assert out.columns == ["id", "t", "part", "version", "vec"]
    assert vectors(out) == {0: (2, 1), 1: (3, 1), 2: (1, 1)}
    assert [(r.version, r.kind, r.rows, r.parts) for r in store.history().orderBy("version").collect()] == [(1, "append", 4, 1), (2, "append", 1, 2)]

    def never(misses):
        assert misses.count() == 0
        return misses.select("item_key", F.array().cast("array<float>").alias("vec"))

    again = V.VectorStore(spark, at, 99)
    assert again.buckets == 4
    assert vectors(again.read_through(more, "t", spec, never)) == {0: (2, 1), 1: (3, 1), 2: (1, 1)}
    # another batch size is the same spec, another width is not
    assert again.misses(more, "t", E.spec_text({"encoder": "n", "batch_size": 64})).count() == 0
    assert again.misses(more, "t", E.spec_text({"encoder": "n", "width": 2})).count() == 3
    assert again.versions() == [1, 2]


def test_keys_are_those_of_the_cache(spark, at):
    store = V.VectorStore(spark, at)
    store.read_through(items(spark, ["aa"]), "t", "{}", V.by_encoder("t", encoder, 2))
    assert store.read().first().item_key == hashlib.sha256(b"{}\x00aa").hexdigest()
    assert E.cache_misses(items(spark, ["aa", "b"]), "t", "{}", store.read()).select("t").collect() == [("b",)]


def test_two_writers_leave_one_row_a_key(spark, at, monkeypatch):
    one, two = V.VectorStore(spark, at), V.VectorStore(spark, at)
    rows = lambda keys, v: spark.createDataFrame([(k, [float(v)]) for k in keys], V.SCHEMA)
    put, raced = one._put, []

    def slower(entry):
        if not raced:  # the other writer commits between the staging and the commit of the first
            raced.append(two.append(rows("bcd", 2), "two"))
        return put(entry)

    monkeypatch.setattr(one, "_put", slower)
    assert one.append(rows("abc", 1), "one") == 1 and raced == [3]
    assert sorted((r.item_key, r.vec[0]) for r in one.read().collect()) == [("a", 1), ("b", 2), ("c", 2), ("d", 2)]
    assert one.versions() == [1, 2] and one.head()["spec"] == "one"
    raced.clear()

    def slow_again(entry):
        if not raced:
            raced.append(two.append(rows("ef", 3)))
        return put(entry)

    monkeypatch.setattr(one, "_put", slow_again)
    assert one.append(rows("ef", 4)) == 0  # nothing is left to add
    assert one.versions() == [1, 2, 3] and one.read().count() == 6


def test_a_part_without_a_commit_is_not_read(spark, at):
    store = V.VectorStore(spark, at)
    store.append(spark.createDataFrame([("a", [1.0])], V.SCHEMA))
    part, n = store._stage(spark.createDataFrame([("b", [1.0]), ("c", [1.0])], V.SCHEMA))  # a writer that dies here
    assert n == 2 and [r.item_key for r in store.read().collect()] == ["a"]
    assert store.vacuum() == [part] and store.read().count() == 1


def test_compaction(spark, at, monkeypatch):
    store, other = V.VectorStore(spark, at, 2), V.VectorStore(spark, at, 2)
    rows = lambda keys: spark.createDataFrame([(k, [1.0]) for k in keys], V.SCHEMA)
    assert store.compact() == 0
    for keys in ("ab", "cd", "ef"):
        store.append(rows(keys))
    before = store.read()
    put, raced = store._put, []
    monkeypatch.setattr(store, "_put", lambda e: (raced or raced.append(other.append(rows("gh")))) and put(e) or put(e))
    version = store.compact()
    assert version == 5 and len(store.head()["parts"]) == 2 and store.read().count() == 8
    assert before.count() == 6 and store.read(3).count() == 6  # readers of an older commit go on
    gone = store.vacuum()
    assert len(gone) == 3 and store.read().count() == 8 and store.versions() == [5]
    files = [f for f in store.read().inputFiles()]
    assert all("bucket=" in f for f in files)


def test_compacted_by_another(spark, at, monkeypatch):
    store, other = V.VectorStore(spark, at), V.VectorStore(spark, at)
    for key in "ab":
        store.append(spark.createDataFrame([(key, [1.0])], V.SCHEMA))
    stage = store._stage

    def slow(rows):
        out = stage(rows)
        other.compact()
        return out

    monkeypatch.setattr(store, "_stage", slow)
    with pytest.raises(GateError, match="another writer"):
        store.compact()
    assert store.read().count() == 2


def test_nothing_to_append(spark, at):
    store = V.VectorStore(spark, at)
    assert store.read_through(items(spark, ["a"]).limit(0), "t", "{}", V.by_encoder("t", encoder, 2)).count() == 0
    assert store.versions() == [] and store.read().count() == 0
    with pytest.raises(PySparkException):
        store.read_through(items(spark, ["a"]), "t", "{}", V.by_encoder("t", encoder, 3))
    assert store.versions() == []


def test_a_commit_is_whole(spark, at):
    store = V.VectorStore(spark, at)
    store.append(spark.createDataFrame([("a", [1.0])], V.SCHEMA), "s")
    entry = store.head()
    assert not store._put(entry | {"rows": 7})
    assert store.head() == entry and json.dumps(entry)
    assert set(entry) == {"version", "parts", "kind", "rows", "spec", "buckets"}


def digest(rows, fan):
    level = [hashlib.md5("\x1f".join(r).encode()).hexdigest() for r in rows]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) <= 1:
            return level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("n", "fan"), [(0, 4), (1, 4), (4, 4), (5, 4), (64, 4), (67, 4), (300, 1024)])
def test_ordered_fingerprint(spark, n, fan):
    df = spark.createDataFrame([(i, f"v{i * 7 % 13}", i) for i in range(n)], "k long, v string, _at int")
    want = (n, digest([(str(i), f"v{i * 7 % 13}") for i in range(n)], fan))
    for layout in (df, df.repartition(7), df.orderBy(F.desc("k"))):
        assert tuple(E.ordered_fingerprint(layout, ["k", "v"], ["k"], fan).first()) == want


def test_two_rows_that_change_places(spark):
    rows = [(i, str(i)) for i in range(40)]
    frame = lambda r: spark.createDataFrame([(at, v) for at, (_, v) in enumerate(r)], "at int, v string")
    swapped = [*rows[:10], rows[11], rows[10], *rows[12:]]
    first, other = (E.ordered_fingerprint(frame(r), ["v"], ["at"], 8).first() for r in (rows, swapped))
    assert first.n == other.n and first.fingerprint != other.fingerprint
    assert E.fingerprint(frame(rows), ["v"]).first() == E.fingerprint(frame(swapped), ["v"]).first()


def test_colocated_residues_are_not_shuffled(spark):
    """Below the join the residue table has no exchange; the positions are dealt to its buckets."""
    residues = spark.createDataFrame([(k, p, [float(k), float(p)]) for k in range(40) for p in range(12)], "id int, position int, vec array<float>")
    at = spark.createDataFrame([(k, k % 12) for k in range(40)], "id int, position int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = E.readout(E.colocated(residues, "id", "residues_in_buckets", 8), "id", "at_position", at)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in out._jdf.queryExecution().simpleString() + plan
        assert {r.id: tuple(r.vec) for r in out.collect()} == {k: (k, k % 12) for k in range(40)}
        plain = E.readout(residues, "id", "at_position", at)
        assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table if exists residues_in_buckets")


def test_long_texts_come_in_small_batches(spark):
    """Texts of 100 KB stand together in a task; what its Python holds of them at once is bounded."""
    rows = spark.range(200).select("id", F.concat(F.lit("x"), F.repeat(F.lit("word "), 20_000)).alias("text")).repartition(1)

    def encoder():
        import sys

        return lambda texts: [[float(sys._getframe(1).f_locals["frame"]["_t"].str.len().sum())] for _ in texts]

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    held = E.encoded(rows, "id", "text", encoder, 1).select(F.col("vec")[0].alias("n")).agg(F.max("n"), F.count("*")).first()
    assert held[0] <= 3e6 and held[1] == 200
