"""Messages delivered at least once: a partitioned store that keeps exactly one copy of each.

Layout under one folder: ``rows/gen=.../part=...`` holds the kept rows by partition, ``index/gen=.../bucket=...``
maps each message to the partition it lives in, and ``manifest-N`` names the generations that are valid for every
partition and bucket. A merge reads the index buckets of its own messages only, writes new generations of the affected
partitions, adds what is new to the index as further generations of its buckets, and publishes by creating the next
manifest, which only one merge can. Readers see the old or the new state, and a job that dies halfway leaves nothing
visible.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of the name of a partition that holds rows without partition value.
NONE = "none"


def message_id(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the identifier columns; nulls are told apart from every value and equal each other."""
    parts = [p for c in cols for p in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("id_a"), F.xxhash64(F.lit("strandline"), *reversed(parts)).alias("id_b")]


ID = ["id_a", "id_b"]
INDEX = "id_a bigint, id_b bigint, home string, bucket int"


class Conflict(RuntimeError):
    """Another merge has published since this one read the manifest."""


class MessageStore:
    """``order``: columns that decide the winner, greatest first wins (nulls lose). ``columns``: what a row keeps beside
    id, ``part`` and order. Repeated identical rows count as copies of each other and one stays.

    The index has a power of two of buckets, doubled whenever they hold more than ``bucket_rows`` messages each on
    average, so a bucket stays of one size while the store grows; a bucket of more than ``deltas`` generations is
    written anew as one by the merge that touches it.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], columns: list[str] | None = None, *, bucket_rows: int = 2_000_000, deltas: int = 8) -> None:
        self.spark, self.path, self.order, self.columns, self.bucket_rows, self.deltas = spark, path.rstrip("/"), order, columns or [], bucket_rows, deltas
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._p("")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._p("")))
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets", "messages", "rows": {partition: generation}, "index": {bucket: [generation]}}; as many entries as
        partitions and generations of buckets."""
        known = self._versions() if version is None else [version]
        if not known:
            return {"version": 0, "buckets": 1, "messages": 0, "rows": {}, "index": {}}
        stream = self._fs.open(self._p(f"manifest-{known[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Creates the next manifest from a finished file; who comes second fails with :class:`Conflict`."""
        new, final = self._p(f"staged/manifest-{uuid.uuid4().hex}"), self._p(f"manifest-{manifest['version']}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.getScheme() == "file":  # a rename of local files replaces the target, a link does not
            try:
                os.link(new.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                raise Conflict(self.path) from None
            self._fs.delete(new, False)
        elif self._fs.exists(final) or not self._fs.rename(new, final):
            raise Conflict(self.path)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the manifests before the last ``keep``, and the generations that none of those names; returns them.
        Not beside a running merge, whose generations no manifest names yet."""
        versions = self._versions()
        held = {"rows": set(), "index": set()}
        for v in versions[-keep:]:
            m = self.manifest(v)
            held["rows"].update(m["rows"].values())
            held["index"].update(g for gens in m["index"].values() for g in gens)
        gone = []
        for kind, used in held.items():
            if self._fs.exists(self._p(kind)):
                gone += [f"{kind}/{n}" for n in (f.getPath().getName() for f in self._fs.listStatus(self._p(kind))) if n.startswith("gen=") and n[4:] not in used]
        gone += [f"manifest-{v}" for v in versions[:-keep]]
        for name in gone:
            self._fs.delete(self._p(name), True)
        return gone

    def _read(self, kind: str, which: list[tuple[str, str]], schema: str) -> DataFrame:
        """``which``: (generation, partition or bucket)."""
        key = "part" if kind == "rows" else "bucket"
        if not which:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/gen={g}/{key}={p}" for g, p in sorted(which)]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(f"{schema}, gen string").parquet(*paths).drop("gen")

    def _index(self, manifest: dict, buckets: list[int]) -> DataFrame:
        return self._read("index", [(g, str(b)) for b in buckets for g in manifest["index"].get(str(b), ())], INDEX)

    def _row_schema(self, like: DataFrame) -> str:
        kinds = dict(like.dtypes)
        return ", ".join(f"`{c}` {kinds[c]}" for c in [*ID, *self.columns, *self.order]) + ", part string"

    def winners(self, like: DataFrame) -> DataFrame:
        """The kept rows; ``like`` gives the types."""
        return self._read("rows", [(g, p) for p, g in self.manifest()["rows"].items()], self._row_schema(like))

    def _best(self, rows: DataFrame) -> DataFrame:
        """One row per message: partial aggregation keeps a hot message to one row per task before the shuffle."""
        top = F.max(F.struct(*self.order, *self.columns, "part")).alias("top")
        return rows.groupBy(*ID).agg(top).select(*ID, *[F.col(f"top.{c}").alias(c) for c in [*self.columns, *self.order, "part"]])

    def merge(self, incoming: DataFrame, attempts: int = 5) -> list[str]:
        """Take in ``incoming`` (id_a, id_b, part and the store's columns) and return the partitions that were overwritten.

        The index tells in which partitions the incoming messages already live; only these are read, joined by the
        incoming rows, decided anew and written, together with the partitions that get new messages. A merge that
        another one overtakes starts again on what that one left, ``attempts`` times in all.
        """
        generation = uuid.uuid4().hex
        staged = f"{self.path}/staged/{generation}"
        self._best(incoming.select(*ID, *self.columns, *self.order, F.coalesce("part", F.lit(NONE)).alias("part"))).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        try:
            for attempt in range(attempts):
                try:
                    return self._merge(fresh, self.manifest(), f"{generation}{attempt}")
                except Conflict:
                    if attempt == attempts - 1:
                        raise
        finally:
            self._fs.delete(self._p(f"staged/{generation}"), True)
        return []

    def _merge(self, fresh: DataFrame, old: dict, generation: str) -> list[str]:
        n = old["buckets"]
        bucket = lambda n: F.pmod("id_a", F.lit(n)).cast("int").alias("bucket")
        asked = sorted(r.bucket for r in fresh.select(bucket(n)).distinct().collect())  # buckets, not messages
        where = self._index(old, asked).select(*ID, "home")
        # a message that is known stays in its partition, so that one partition decides about all copies
        placed = fresh.join(where, ID, "left").withColumn("part", F.coalesce("home", "part")).withColumn("is_new", F.col("home").isNull()).drop("home")
        staged = f"{self.path}/staged/{generation}-placed"
        placed.write.parquet(staged)
        placed = self.spark.read.parquet(staged)
        touched = sorted(r.part for r in placed.select("part").distinct().collect())  # partitions, not messages
        held = self._read("rows", [(g, p) for p, g in old["rows"].items() if p in touched], self._row_schema(fresh))
        kept = self._best(held.select(*ID, *self.columns, *self.order, "part").unionByName(placed.drop("is_new")))
        kept.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/rows/gen={generation}")
        new = placed.where("is_new").select(*ID, F.col("part").alias("home"))
        messages = old["messages"] + new.count()
        index = {b: list(g) for b, g in old["index"].items()}
        grown = n
        while messages > grown * self.bucket_rows:
            grown *= 2
        if grown > n:  # every bucket splits; as the store has doubled since, each message moves a bounded number of times
            rows, index = self._index(old, list(range(n))).select(*ID, "home").unionByName(new), {}
        else:
            full = [b for b in asked if len(index.get(str(b), ())) >= self.deltas]
            rows = self._index(old, full).select(*ID, "home").unionByName(new) if full else new
            for b in full:
                index[str(b)] = []
        rows.select(*ID, "home", bucket(grown)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/index/gen={generation}")
        if self._fs.exists(self._p(f"index/gen={generation}")):
            for f in self._fs.listStatus(self._p(f"index/gen={generation}")):
                name = f.getPath().getName()
                if name.startswith("bucket="):
                    index.setdefault(name[7:], []).append(generation)
        self._publish({"version": old["version"] + 1, "buckets": grown, "messages": messages, "rows": old["rows"] | dict.fromkeys(touched, generation), "index": index})
        self._fs.delete(self._p(f"staged/{generation}-placed"), True)
        return touched


def surplus(rows: DataFrame, winners: DataFrame, row_key: str) -> DataFrame:
    """The rows of ``rows`` that lost, one per copy: rows are counted by id and ``row_key`` first, so that repeated rows
    leave one of them; the anti-join runs on the row key, which no hot message shares."""
    counted = rows.groupBy(*ID, row_key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    won = winners.select(*ID, row_key, F.lit(1).alias("won"))
    left = counted.join(won, [row_key, *ID], "left").withColumn("n", F.col("n") - F.coalesce("won", F.lit(0)))
    return left.where("n > 0").select(*ID, row_key, F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
