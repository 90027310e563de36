import hashlib
import random
import zlib

import pytest

from plumbline.llm import common
from plumbline.llm.media import LEAST, MOST, chunks_of, container, cuts, media_digests, payload_of, read_container, read_media, store


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["thé", "and", "ring", "onder", "quil", "aster"]) + str(rng.randrange(50)) for _ in range(n))


def test_cuts_bounds_and_shift():
    text = passage(1, 9000)
    payload, _ = payload_of(text)
    ends = cuts(payload)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(payload) and all(LEAST <= s <= MOST for s in sizes[:-1])
    a, b = dict(chunks_of(payload)), dict(chunks_of(payload_of("Inserted words. " + text)[0]))
    assert len(a.keys() & b.keys()) > 0.9 * len(a)


@pytest.mark.parametrize("text", ["", None, "x", "a" * 576, "a" * 577, "é" * 40_000])
def test_round_trip(text):
    payload, n = payload_of(text)
    assert len(payload) % 576 == 0 and payload and payload[:n] == (text or "").encode()
    assert read_container(container(chunks_of(payload))) == payload


def test_damage_is_found():
    form = bytearray(container(chunks_of(payload_of(passage(2, 300))[0])))
    form[-1] ^= 1
    with pytest.raises(ValueError):
        read_container(bytes(form))


def test_frame(spark):
    shared = passage(3, 3000)
    texts = [shared, shared, "head " + shared, shared + passage(4, 100), passage(5, 200), None, "", "x", "x" * 100_000]
    rows = [(i, t, "y") for i, t in enumerate(texts)] + [(None, shared, "z"), (2, "head " + shared, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    out = media_digests(df).collect()
    assert len(out) == len(rows)
    for r in out:
        payload, n = payload_of(texts[r.doc_id] if r.doc_id is not None else shared)
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        form = container(chunks_of(payload))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
    stored = store(df)
    bodies = sum(len(r.body) for r in stored.single.unionByName(stored.shared).collect())
    distinct = {d: len(p) for t in texts for d, p in chunks_of(payload_of(t)[0])}
    assert bodies == sum(distinct.values())
    assert {r.doc_id: read_container(bytes(r.media)) for r in read_media(stored).collect()}[3] == payload_of(texts[3])[0]
    assert media_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_bits", [0, 1 << 16, 1 << 28])
def test_copies_with_and_without_bitmaps(spark, monkeypatch, most_bits):
    """One text on a third of the rows, repeated rows, and chunks that most texts share: each row comes back once, whatever the bitmaps."""
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    shared = passage(6, 1500)
    rows = [(i, shared) for i in range(60)] + [(i, f"{passage(i, 20)} {shared}") for i in range(60, 120)] + [(i, passage(i, 30)) for i in range(120, 180)]
    rows += [(5, shared)] * 3 + [(130, passage(130, 30)), (None, passage(140, 30)), (None, None), (None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.payload_sha256) for r in media_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted((i is None, i or 0, hashlib.sha256(payload_of(t)[0]).hexdigest()) for i, t in rows)


def test_frequent_keys_join(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 700}", i) for i in range(2000)] + [("none", 1), (None, 2)]
    df = spark.createDataFrame(rows, "key string, v int")
    known = spark.createDataFrame([("hot", 3000, "a")] + [(f"k{i}", 3, str(i)) for i in range(700)] + [("other", 5, "b")], "key string, n long, says string")
    got = sorted((r.key, r.v, r.says) for r in common.with_frequent(df, known, "key", "n").collect())
    assert got == sorted((k, v, "a" if k == "hot" else k[1:]) for k, v in rows if k not in ("none", None))
