"""A table of chunks that takes batches of upserts and deletes, and keeps its versions.

A batch is written as it comes: its rows, each with its position, and a row
without chunk for each URL that it deletes. Its commit adds one small file,
which lists what the table consists of; a batch that fails before has changed
nothing, and readers of earlier versions go on reading them. What a batch costs
follows from the batch, not from the table.

Reading merges: of the rows of a key the last by (batch, position) stands, if
no later row has deleted its URL. The large part of the table, rows() of the
last compact(), isn't sorted or regrouped for that: it loses the keys and URLs
that later batches touch by anti-joins, whose other side Spark broadcasts if it
is small. compact() makes the table one part again.

One writer at a time, as for any table of files without locks: a second one
finds its version's file taken and fails, before anything is lost.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the batches' files beside the chunks' own.
ORDER = "_batch bigint, _position bigint, _deletes boolean"


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    number: int
    base: str | None  # folder of the merged part
    batches: tuple[tuple[int, str], ...]  # number and folder, in order
    streams: dict[str, int]  # the last batch of each stream that loads the table

    def text(self) -> str:
        return json.dumps({"base": self.base, "batches": self.batches, "streams": self.streams})


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str, schema: str, url: str = "url", key: Sequence[str] = ("url", "chunk_number")) -> None:
        self.spark, self.folder, self.url, self.key = spark, folder.rstrip("/"), url, tuple(key)
        self.schema = StructType.fromDDL(schema)
        self.written = StructType([*self.schema.fields, *StructType.fromDDL(ORDER).fields])

    # --- versions ------------------------------------------------------------------

    def _files(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        at, store = self._files(f"{self.folder}/versions")
        if not store.exists(at):
            return []
        names = [f.getPath().getName() for f in store.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """The last version, or an earlier one; number 0 is an empty table."""
        known = self.versions()
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return Version(0, None, (), {})
        at, store = self._files(f"{self.folder}/versions/{number:012d}.json")
        source = store.open(at)
        held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        source.close()
        return Version(number, held["base"], tuple((n, p) for n, p in held["batches"]), held["streams"])

    def _commit(self, made: Version) -> Version:
        """Writes the version's file under another name and renames it, which fails if there is one."""
        at, store = self._files(f"{self.folder}/versions/{made.number:012d}.json")
        draft = self._files(f"{self.folder}/versions/.draft-{self.spark.sparkContext.applicationId}-{made.number}")[0]
        out = store.create(draft, True)
        out.write(bytearray(made.text().encode()))
        out.close()
        if store.exists(at) or not store.rename(draft, at):
            store.delete(draft, False)
            raise Conflict(f"version {made.number} is there already")
        return made

    # --- reading ---------------------------------------------------------------------

    def _part(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.written).parquet(*paths)

    def rows(self, number: int | None = None) -> DataFrame:
        """The table as of the last version, or of an earlier one."""
        v = self.version(number)
        columns = self.schema.names
        base = self._part(v.base) if v.base else self.spark.createDataFrame([], self.written)
        if not v.batches:
            return base.select(*columns)
        later = self._part(*(path for _, path in v.batches))
        at = F.struct("_batch", "_position")
        gone = later.filter("_deletes").groupBy(F.col(self.url).alias("_url")).agg(F.max(at).alias("_gone"))
        newest = Window.partitionBy(*self.key).orderBy(F.desc("_batch"), F.desc("_position"))
        last = later.filter("NOT _deletes").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        alive = last.join(gone, last[self.url].eqNullSafe(gone["_url"]), "left").filter(F.col("_gone").isNull() | (at > F.col("_gone")))
        if not v.base:
            return alive.select(*columns)
        old = base.join(gone.select("_url"), base[self.url].eqNullSafe(F.col("_url")), "left_anti")
        keys = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)))
        same = F.lit(True)
        for i, c in enumerate(self.key):
            same &= old[c].eqNullSafe(F.col(f"_k{i}"))
        return old.join(keys, same, "left_anti").select(*columns).unionByName(alive.select(*columns))

    # --- writing -----------------------------------------------------------------------

    def load(self, rows: DataFrame, position: Column | None = None, replace: bool = False, deletes: DataFrame | None = None, stream: tuple[str, int] | None = None) -> Version:
        """One commit: rows replace those of their key; with replace, all earlier
        rows of their URLs go; deletes (url) go too, before the rows come in.

        position orders the rows of a batch, the last of a key standing; without
        one it is the order in which they come. stream is a stream's name and its
        batch's number, which rises; a batch that the table has isn't loaded again.
        """
        before = self.version()
        if stream is not None and before.streams.get(stream[0], -1) >= stream[1]:
            return before
        number = before.number + 1
        path = f"{self.folder}/batches/{number:012d}"
        names = self.schema.names
        order = F.monotonically_increasing_id() if position is None else position.cast("bigint")
        made = rows.select(*names, F.lit(number).cast("bigint").alias("_batch"), order.alias("_position"), F.lit(False).alias("_deletes"))
        going = [x for x in (rows.select(F.col(self.url)) if replace else None, deletes.select(F.col(self.url)) if deletes is not None else None) if x is not None]
        for urls in going:
            # Position: before any row of the batch.
            marks = urls.distinct().select(*(F.col(self.url) if c == self.url else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names), F.lit(number).cast("bigint").alias("_batch"), F.lit(-(2**63)).cast("bigint").alias("_position"), F.lit(True).alias("_deletes"))
            made = made.unionByName(marks)
        made.write.mode("overwrite").parquet(path, compression="zstd")  # what a load that failed has left is overwritten
        return self._commit(Version(number, before.base, (*before.batches, (number, path)), before.streams | dict([stream] if stream else [])))

    def loaded(self, made: Version) -> int:
        """How many rows the last load of a version brought."""
        return self._part(made.batches[-1][1]).filter("NOT _deletes").count()

    def compact(self) -> Version:
        """The same rows as one part, ordered by key within files."""
        before = self.version()
        path = f"{self.folder}/merged/{before.number + 1:012d}"
        rows = self.rows(before.number).select("*", F.lit(0).cast("bigint").alias("_batch"), F.lit(0).cast("bigint").alias("_position"), F.lit(False).alias("_deletes"))
        rows.repartition(*self.key).sortWithinPartitions(*self.key).write.mode("overwrite").parquet(path, compression="zstd")
        return self._commit(Version(before.number + 1, path, (), before.streams))

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and the files that only they had."""
        known = self.versions()
        held = [self.version(n) for n in known[-keep:]]
        wanted = {v.base for v in held} | {p for v in held for _, p in v.batches}
        for n in known[:-keep]:
            at, store = self._files(f"{self.folder}/versions/{n:012d}.json")
            old = self.version(n)
            store.delete(at, False)
            for path in {old.base, *(p for _, p in old.batches)} - wanted - {None}:
                store.delete(self._files(path)[0], True)
