"""A store of vectors by content: what is there is read, what is missing is encoded and appended, and every append is a commit.

On disk a store is a folder with ``data/part=<id>/bucket=<b>/`` and ``commits/<version>.json``. A part is written whole
before a commit names it, and a commit is a new file that may not exist yet, put in place by a rename: a reader sees the
last commit or the one before, never half of a part, and a writer that dies leaves a part that nothing names. Of two
writers that append at once one takes the version; the other leaves out of its part the keys that were committed
meanwhile, and tries the next version, so that a key has one row.

Keys are digests of the spec (everything that changes a vector) and of the item, so that a changed spec misses and an
item is encoded once however often it occurs. Buckets are ranges of the key's hash: reads that name few buckets open few
folders. ``compact`` writes many small parts as one; ``vacuum`` deletes parts that no kept commit names.

Null items count as blank ones. An empty table of items appends nothing and makes no commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commits import CommitLog
from .features import encoded, item_key
from .gates import GateError

SCHEMA = "item_key string, vec array<float>"
BUCKETS = 16


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        """The store at ``path``, an empty one if there is none; the number of buckets is that of its first commit."""
        self.log = CommitLog(spark, path, ("data",))
        self.spark, self.path = spark, self.log.path
        self.buckets = self.head().get("buckets", buckets)

    def versions(self) -> list[int]:
        return self.log.versions()

    def head(self) -> dict:
        """The last commit: version, parts, kind, rows, spec, buckets."""
        return self.log.head({"parts": []})

    def _put(self, entry: dict) -> bool:
        return self.log.put(entry)

    def _parts(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        read = self.spark.read.schema(f"{SCHEMA}, part string, bucket int").option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/part={p}" for p in parts]).drop("part")

    def read(self, version: int | None = None) -> DataFrame:
        """item_key, vec and bucket of the last commit, or of an earlier one."""
        return self._parts((self.head() if version is None else self.log.entry(version))["parts"])

    def _bucket(self, key: str = "item_key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stage(self, rows: DataFrame) -> tuple[str, int]:
        """Write rows (item_key, vec) as a part that no commit names yet: its id and number of rows."""
        part = uuid.uuid4().hex
        dealt = rows.select("item_key", F.col("vec").cast("array<float>").alias("vec"), self._bucket().alias("bucket"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "item_key").write.partitionBy("bucket").parquet(f"{self.path}/data/part={part}")
        return part, self._count(part)

    def _count(self, part: str) -> int:
        return self._parts([part]).count() if any(n.startswith("bucket=") for n in self.log.names(f"data/part={part}")) else 0

    def _drop(self, part: str) -> None:
        self.log.drop(f"data/part={part}")

    def append(self, rows: DataFrame, spec: str = "") -> int:
        """Commit rows (item_key, vec; one a key) whose key the store lacks; the number of rows that this commit adds.

        Keys that another writer commits before this one does are left out.
        """
        base = self.head()
        part, n = self._stage(self._lacking(rows, base["parts"]))
        while True:
            if not n:
                self._drop(part)
                return 0
            entry = {"version": base["version"] + 1, "parts": [*base["parts"], part], "kind": "append", "rows": n, "spec": spec, "buckets": self.buckets}
            if self._put(entry):
                return n
            last = self.head()
            newer = [p for p in last["parts"] if p not in base["parts"]]
            kept, m = self._stage(self._lacking(self._parts([part]), newer))
            self._drop(part)
            base, part, n = last, kept, m

    def _lacking(self, rows: DataFrame, parts: list[str]) -> DataFrame:
        if not parts:
            return rows
        held = self._parts(parts).select("bucket", "item_key")
        return rows.withColumn("bucket", self._bucket()).join(held, ["bucket", "item_key"], "left_anti")

    def misses(self, items: DataFrame, item: str, spec: str) -> DataFrame:
        """item_key and item of the distinct items that have no vector under this spec."""
        text = F.coalesce(F.col(item), F.lit(""))
        keyed = items.select(text.alias(item)).distinct().withColumn("item_key", item_key(spec, F.col(item)))
        return self._lacking(keyed, self.head()["parts"]).select("item_key", item)

    def read_through(self, items: DataFrame, item: str, spec: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``items`` with vec: vectors that the store has are read, others are encoded by ``encode`` (item_key, item) -> (item_key, vec) and appended first.

        The returned rows read the commit that holds all of them, whatever is appended later.
        """
        self.append(encode(self.misses(items, item, spec)), spec)
        version = self.head()["version"]
        keyed = items.withColumn("item_key", item_key(spec, F.coalesce(F.col(item), F.lit("")))).withColumn("bucket", self._bucket())
        stored = self.read(version) if version else self.read()
        return keyed.join(stored, ["bucket", "item_key"], "left").drop("bucket", "item_key")

    def history(self) -> DataFrame:
        """version, kind, rows, parts, spec of every commit."""
        entries = [self.log.entry(v) for v in self.versions()]
        return self.spark.createDataFrame([(e["version"], e["kind"], e["rows"], len(e["parts"]), e["spec"]) for e in entries], "version int, kind string, rows long, parts int, spec string")

    def compact(self) -> int:
        """Write the parts of the last commit as one; parts that are committed meanwhile stay beside it. The new version, or 0 if there is nothing to do."""
        base = self.head()
        if len(base["parts"]) < 2:
            return 0
        part, n = self._stage(self._parts(base["parts"]))
        while True:
            last = self.head()
            if lost := set(base["parts"]) - set(last["parts"]):
                self._drop(part)
                raise GateError(f"{len(lost)} parts were compacted by another writer")
            newer = [p for p in last["parts"] if p not in base["parts"]]
            entry = {"version": last["version"] + 1, "parts": [part, *newer], "kind": "compact", "rows": n, "spec": "", "buckets": self.buckets}
            if self._put(entry):
                return entry["version"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the parts that none of the last ``keep`` commits names, and their commits; not while another writer is at work. The deleted parts."""
        versions = self.versions()
        named = {p for v in versions[-keep:] for p in self.log.entry(v)["parts"]}
        there = [n.removeprefix("part=") for n in self.log.names("data")]
        gone = sorted(p for p in there if p not in named)
        for v in versions[:-keep]:
            self.log.drop(f"commits/{v:08d}.json")
        for p in gone:
            self._drop(p)
        return gone


def by_encoder(item: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], width: int, batch: int = 8) -> Callable[[DataFrame], DataFrame]:
    """An ``encode`` for :meth:`VectorStore.read_through` from a user's encoder; blank items are zero vectors."""
    return lambda misses: encoded(misses, "item_key", item, encoder, width, batch)
