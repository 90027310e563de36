"""Media columns in content-defined chunks (operator 1).

A payload of 8-bit samples is cut where a rolling gear hash of its last 64 bytes meets a mask, so that equal passages
give equal chunks wherever they stand. Equal payloads are one medium, named by a 128-bit key; chunks are named by
digest. Spark finds for each digest the medium with the smallest key that has it; this medium owns the chunk and keeps
its bytes, all others keep the digest in their ordered chunk list. The store is a written table of chunk lists and
owned bytes, one row a medium. Reading joins the chunks that a list names but its row does not own, puts the payload
together in order, and verifies it against the digest noted when it was stored.

Media of one document that own all of their chunks are stored and read where their text is. Of the others, one
document carries the text to its medium's row and the other copies send their key alone; bitmaps sized by the number of
such media tell the texts that must travel, and above a ceiling all travel.

The stored form of one medium is its container: a head, the ordered list of (digest, length), then every distinct
chunk once in order of appearance. It depends on the payload alone, so equal texts give equal values.

Null texts count as empty; an empty text is a payload of padding. Rows with a null doc_id and repeated rows are copies
like others and are returned each. An empty table gives no rows. Other columns are left behind, whatever their names.
Chunks are bounded in size, payloads are not.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FREQUENT, bits_of, cut, has_bits, map_batches, may_hold, mix, table, texts_of, with_frequent

UNIT, PAD = 576, 255
LEAST, MOST, MASK_BITS = 256, 8192, 10
HEAD = b"CHUNKED1"
_GEAR = mix(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text, and the length before padding."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT), len(raw)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload: where the gear hash of the last 64 bytes has MASK_BITS high zeros, within LEAST to MOST bytes."""
    n = len(payload)
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in range(6):  # after step k, the hash of the last 2 << k bytes
        shifted = h[: -(1 << k)] << np.uint64(1 << k)
        h = h.copy()
        h[1 << k :] += shifted
    found = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, at = [], 0
    while at < n:
        i = np.searchsorted(found, at + LEAST)
        end = int(found[i]) if i < len(found) else n
        at = min(end, at + MOST, n)
        out.append(at)
    return out


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """Ordered (digest, bytes)."""
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(hashlib.blake2b(p, digest_size=16).digest(), p) for p in parts]


def container(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form of one medium."""
    return HEAD + struct.pack("<I", len(chunks)) + b"".join(d + struct.pack("<I", len(p)) for d, p in chunks) + b"".join(dict(chunks).values())


def read_container(stored: bytes) -> bytes:
    """The payload of a container; a chunk that does not match its digest is an error."""
    if stored[: len(HEAD)] != HEAD:
        raise ValueError("not a container")
    n = struct.unpack_from("<I", stored, len(HEAD))[0]
    at, listed = len(HEAD) + 4, []
    for _ in range(n):
        listed.append((stored[at : at + 16], struct.unpack_from("<I", stored, at + 16)[0]))
        at += 20
    held: dict[bytes, bytes] = {}
    for digest, size in listed:
        if digest not in held:
            held[digest] = stored[at : at + size]
            at += size
            if hashlib.blake2b(held[digest], digest_size=16).digest() != digest:
                raise ValueError("a chunk does not match its digest")
    return b"".join(held[d] for d, _ in listed)


SINGLE, PENDING = 0, 1


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, int, bytes]]:
    """doc_id, payload, length before padding and 128-bit key of the payload of each row."""
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        payload, n = payload_of(text)
        yield i, payload, n, hashlib.blake2b(payload, digest_size=16).digest()


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the key k1, k2 of the medium, and the distinct chunk digests of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, keys, digests = [], [], [], []
        for i, payload, n, key in _rows_of(batch):
            ids.append(i)
            sizes.append(n)
            keys.append(key)
            digests.append(list(dict.fromkeys(d for d, _ in chunks_of(payload))))
        k = _halves(keys)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "k1", "k2", "digests"])

    return map_batches(docs, run, "doc_id long, n_bytes long, k1 long, k2 long, digests array<binary>")


_STORED = "kind int, doc_id long, n_bytes long, k1 long, k2 long, digests array<binary>, sizes array<int>, payload_digest binary, others array<binary>, body binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _STORED.split(", ")])


def _entry(kind: int, doc_id: int | None, n: int, k1: int, k2: int, payload: bytes, others: list[bytes]) -> tuple:
    """One store row: the ordered chunk list, and the bytes of the chunks that no other medium owns."""
    chunks, lacking = chunks_of(payload), set(others)
    own = {d: p for d, p in chunks if d not in lacking}
    return kind, doc_id, n, k1, k2, [d for d, _ in chunks], [len(p) for _, p in chunks], hashlib.sha256(payload).digest(), others, b"".join(own.values())


def _direct(docs: DataFrame, special: np.ndarray | None, carriers: np.ndarray | None) -> DataFrame:
    """Store rows of the media that surely have one document and all their chunks; texts of the other media's carriers wait (PENDING).

    ``special`` and ``carriers`` are bitmaps; without them every text waits.
    """
    shared = docs.sparkSession.sparkContext.broadcast((special, carriers))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marked, carried = shared.value
        found = list(_rows_of(batch))
        k = _halves([r[3] for r in found])
        ids = np.array([-1 if r[0] is None else r[0] for r in found], np.int64)
        waits = has_bits(marked, k[:, 0]) if marked is not None else np.ones(len(found), bool)
        goes = has_bits(carried, k[:, 1] ^ ids) if carried is not None else np.ones(len(found), bool)
        out = []
        for (i, payload, n, _), (k1, k2), w, g in zip(found, k.tolist(), waits.tolist(), goes.tolist(), strict=True):
            if not w:
                out.append(_entry(SINGLE, i, n, k1, k2, payload, []))
            elif g:
                out.append((PENDING, i, n, k1, k2, None, None, None, None, payload))
        return _packed(out)

    return map_batches(docs, run, _STORED)


def _settled(pending: DataFrame) -> DataFrame:
    """Store rows from pending payloads with ``others``, the chunks that another medium owns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _packed([_entry(r["kind"], r["doc_id"], r["n_bytes"], r["k1"], r["k2"], r["body"], r["others"] or []) for r in batch.to_pylist()])

    return map_batches(pending, run, _STORED)


@dataclass(frozen=True)
class Store:
    """``documents`` (doc_id, n_bytes, k1, k2), ``special`` media (k1, k2, n documents, carrier, others), ``held`` chunks
    (k1, k2, digest, owner), and the written rows: ``single`` media of one document, and ``shared`` ones."""

    documents: DataFrame
    special: DataFrame
    held: DataFrame
    single: DataFrame
    shared: DataFrame


def store(documents: DataFrame) -> Store:
    """The chunk store of the texts, with one row for each medium."""
    docs = texts_of(documents)
    lists = cut(chunk_lists(docs), "lists")
    occurring = lists.select("k1", "k2", F.explode("digests").alias("digest"))
    owners = occurring.groupBy("digest").agg(F.min("k1").alias("owner"), F.max("k1").alias("last"), F.count("*").alias("n")).where("owner <> last")
    owners = cut(owners.select("digest", "owner", "n"), "owners")
    lacking = with_frequent(may_hold(occurring, "digest", owners), owners, "digest", "n").where("k1 <> owner").select("k1", "k2", "digest", "owner")
    held = cut(lacking.distinct(), "held")
    media = lists.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("carrier"))
    others = held.groupBy("k1", "k2").agg(F.collect_list("digest").alias("others"))
    special = cut(media.join(others, ["k1", "k2"], "left").where("n > 1 or others is not null"), "special")
    size = special.count()
    marked = bits_of(special.select("k1"), size)
    carriers = None
    if marked is not None:
        # media that the bitmap takes for special ones: their texts wait as well
        shared = docs.sparkSession.sparkContext.broadcast(marked)
        taken = map_batches(lists.select("doc_id", "k1", "k2"), lambda b: b.filter(pa.array(has_bits(shared.value, b.column("k1").to_numpy()))), "doc_id long, k1 long, k2 long")
        mistaken = taken.join(special, ["k1", "k2"], "left_anti")
        ids = special.select("k2", F.col("carrier").alias("doc_id")).unionByName(mistaken.select("k2", "doc_id"))
        carriers = bits_of(ids.select(F.col("k2").bitwiseXOR(F.coalesce("doc_id", F.lit(-1))).alias("k")), 2 * size)
    rows = cut(_direct(docs, marked, carriers), "rows")
    pending = rows.where(F.col("kind") == PENDING).drop("others")
    # without bitmaps all copies wait: those of frequent media, which are few, leave before the shuffle
    total = special.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = F.broadcast(special.where(F.col("n") >= max(2, total / FREQUENT)).select("k1", "k2", F.struct("carrier").alias("_top")))
    pending = pending.join(top, ["k1", "k2"], "left").where(F.col("_top").isNull() | F.col("doc_id").eqNullSafe(F.col("_top.carrier"))).drop("_top")
    pending = pending.alias("p").join(special.alias("s"), ["k1", "k2"], "left")
    first = pending.where("s.n is null or p.doc_id <=> s.carrier")
    first = first.select(F.when(F.col("s.n").isNull(), SINGLE).otherwise(PENDING).alias("kind"), "p.doc_id", "n_bytes", "k1", "k2", "others", "body")
    # a carrier that is there twice is stored once; a medium with one document has no second row
    once = first.dropDuplicates(["k1", "k2"])
    settled = cut(_settled(once), "settled")
    return Store(lists.select("doc_id", "n_bytes", "k1", "k2"), special, held, rows.where(F.col("kind") == SINGLE).unionByName(settled.where(F.col("kind") == SINGLE)), settled.where(F.col("kind") == PENDING))


def _owned(digests: list[bytes], sizes: list[int], others: list[bytes] | None, body: bytes) -> dict[bytes, bytes]:
    skip, own, at = set(others or ()), {}, 0
    for d, n in zip(digests, sizes, strict=True):
        if d not in skip and d not in own:
            own[d] = body[at : at + n]
            at += n
    return own


def fetched(stored: Store) -> DataFrame:
    """The rows of the shared media with ``fetched``: the chunks that they name and do not own."""
    wanted = cut(stored.held.groupBy("digest").agg(F.min("owner").alias("k1"), F.count("*").alias("n")), "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [x for r in batch.to_pylist() for x in _owned(r["digests"], r["sizes"], r["others"], r["body"]).items()]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.binary()), pa.array([p for _, p in own], pa.binary())], names=["digest", "bytes"])

    owning = may_hold(stored.single.unionByName(stored.shared), "k1", wanted)
    taken = may_hold(map_batches(owning.select("digests", "sizes", "others", "body"), run, "digest binary, bytes binary"), "digest", wanted)
    chunks = cut(taken.dropDuplicates(["digest"]).join(wanted.select("digest", "n"), "digest"), "chunks")
    # chunks are of MOST bytes, so that the frequent ones are small enough to be sent to all tasks
    brought = with_frequent(stored.held.select("k1", "k2", "digest"), chunks, "digest", "n").groupBy("k1", "k2").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    return stored.shared.join(brought, ["k1", "k2"], "left")


def _chunks(row: dict) -> list[tuple[bytes, bytes]]:
    have = _owned(row["digests"], row["sizes"], row["others"], row["body"]) | {x["digest"]: x["bytes"] for x in row.get("fetched") or ()}
    if lack := [d for d in row["digests"] if d not in have]:
        raise ValueError(f"{len(lack)} chunks of a medium are not in the store")
    chunks = [(d, have[d]) for d in row["digests"]]
    if hashlib.sha256(b"".join(p for _, p in chunks)).digest() != row["payload_digest"]:
        raise ValueError("a medium does not read back as stored")
    return chunks


def for_each(stored: Store, describe: Callable[[list[tuple[bytes, bytes]]], tuple], fields: str) -> DataFrame:
    """doc_id, n_bytes and what ``describe`` says of the chunks of each document's medium, read from the store once a medium."""
    kinds = dict(f.split() for f in fields.split(", "))
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [describe(_chunks(r)) for r in batch.to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "k1", "k2")), *(pa.array([r[k] for r in out], types[t]) for k, t in enumerate(kinds.values()))], names=["doc_id", "n_bytes", "k1", "k2", *kinds])

    schema = f"doc_id long, n_bytes long, k1 long, k2 long, {fields}"
    single = map_batches(stored.single, run, schema).select("doc_id", "n_bytes", *kinds)
    of_medium = cut(map_batches(fetched(stored), run, schema).drop("doc_id", "n_bytes").join(stored.special.select("k1", "k2", "n"), ["k1", "k2"]), "described")
    # the most frequent media are few, and their descriptions are sent to all tasks
    copies = with_frequent(may_hold(stored.documents, "k1", of_medium), of_medium, ["k1", "k2"], "n").select("doc_id", "n_bytes", *kinds)
    return single.unionByName(copies)


def read_media(stored: Store) -> DataFrame:
    """doc_id, n_bytes, media: each document's container, from the chunks of the store."""
    return for_each(stored, lambda chunks: (container(chunks),), "media binary")


def feature(payload: bytes, n_chunks: int, n_distinct: int) -> str:
    """Chunks, distinct chunks, mean and deviation of the samples, most frequent sample."""
    samples = np.frombuffer(payload, np.uint8)
    return f"{n_chunks}:{n_distinct}:{samples.mean():.4f}:{samples.std():.4f}:{np.bincount(samples, minlength=256).argmax()}"


def _described(chunks: list[tuple[bytes, bytes]]) -> tuple:
    form = container(chunks)
    payload = read_container(form)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload, len(chunks), len(dict(chunks)))


def media_digests(documents: DataFrame) -> DataFrame:
    """Store the texts of ``documents`` as media, read them back, and describe what was read."""
    return for_each(store(documents), _described, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_media": op1_media}
SQL: dict[str, str] = {}
