"""The orphan state driven by a stream: every micro-batch is one step, and a restart goes on from the last one."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamarind.operators import orphans as O

REFS = "relation string, child_id string, key string, period string, child_loaded timestamp"
PARENTS = "relation string, key string, parent_loaded timestamp, deleted_at timestamp"


class OrphanStream:
    """Feed `step` to writeStream.foreachBatch. Rows carry kind ('ref' or 'parent') and the union of both columns.

    The state is tables in `folder`, which all machines share, one version an epoch: a manifest, written last, names the
    tables of its epoch. An epoch that has its manifest is not applied again, so a retried batch counts once; a new
    object finds the newest manifest, so a restart forgets nothing. Every COMPACT epochs the parts are written as one; the
    tables that the newest two manifests don't name are removed then.
    """

    COMPACT = 20

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """The epochs that have been applied and whose manifests are still there."""
        found = self._fs.globStatus(self._path("manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def _manifest(self, epoch: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{epoch:012d}.json", wholetext=True).first()[0])

    def state(self) -> O.State:
        """The state after the last epoch."""
        there = self.epochs()
        if not there:
            return O.empty(self.spark.createDataFrame([], REFS), self.spark.createDataFrame([], PARENTS))
        m = self._manifest(there[-1])
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        probed = lambda name: read(name, f"{REFS}, known boolean, why string")
        parts = [(s, probed(p).where("known").drop("known")) for s, p in m["parts"]]
        reopened = read(m["reopened"], "relation string, key string, step int") if m["reopened"] else None
        return O.State(read(m["index"], PARENTS), probed(m["probed"]).where("NOT known").drop("known", "why"), parts, reopened)

    def step(self, batch: DataFrame, epoch: int) -> None:
        there = self.epochs()
        if there and epoch <= there[-1]:
            return
        refs = batch.where("kind = 'ref'").select("relation", "child_id", "key", "period", "child_loaded")
        pars = batch.where("kind = 'parent'").select("relation", "key", "parent_loaded", "deleted_at")
        keep = self._keep(epoch)
        before, m = self.state(), self._manifest(there[-1]) if there else {"parts": []}
        parts = m["parts"]
        if len(parts) >= self.COMPACT:
            whole = O.known(before).selectExpr(*[c.split()[0] for c in REFS.split(", ")], "true AS known", "why")
            parts = [[before.step, keep(whole, "compacted", True)]]
            before = O.State(before.index, before.pending, [(before.step, self.spark.read.parquet(f"{self.folder}/{parts[0][1]}").drop("known"))])
        O.advance(before, refs, pars, keep)
        name = lambda table: f"epoch-{epoch:012d}-{table}"
        made = {"index": name("index"), "probed": name("probed"), "parts": [*parts, [before.step + 1, name("probed")]], "reopened": name("reopened") if before.parts else None}
        half = f"manifest-{epoch:012d}.json.half"
        out = self._fs.create(self._path(half), True)
        out.write(bytearray(json.dumps(made), "utf-8"))
        out.close()
        self._fs.rename(self._path(half), self._path(f"manifest-{epoch:012d}.json"))
        if len(m["parts"]) >= self.COMPACT:
            self._clean()

    def _keep(self, epoch: int) -> Callable:
        def keep(df: DataFrame, table: str, name_only: bool = False):
            path = f"epoch-{epoch:012d}-{table}"  # what a step that stopped left is written over
            df.write.mode("overwrite").parquet(f"{self.folder}/{path}")
            return path if name_only else self.spark.read.schema(df.schema).parquet(f"{self.folder}/{path}")

        return keep

    def _clean(self) -> None:
        """Removes the tables and manifests that the newest two manifests don't need."""
        there = self.epochs()
        needed: set[str] = set()
        for e in there[-2:]:
            m = self._manifest(e)
            needed |= {m["index"], m["probed"], m["reopened"] or "", *(p for _, p in m["parts"])}
        for f in self._fs.globStatus(self._path("epoch-*")) or []:
            if f.getPath().getName() not in needed:
                self._fs.delete(f.getPath(), True)
        for e in there[:-2]:
            self._fs.delete(self._path(f"manifest-{e:012d}.json"), False)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
