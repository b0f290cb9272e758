"""Messages delivered more than once (problem 7): a hash-bucketed, sorted store of messages, keyed by identifier."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import folded
from sightline.session import shared_dir, workspace


class MessageStore:
    """One row for each message, in sorted runs: tables in `buckets` hash buckets of the message's key, one file a bucket, sorted by that key.

    upsert() collapses a batch to one copy of each message and appends it as one more run. compact() merges the runs two by two: a merge join of
    tables that are bucketed and sorted alike, so without a shuffle or a sort, in which equal keys meet and collapse to the copy to keep. Both take
    the minimum by (`at` with null last, `order`), so a batch that is upserted again, or batches that come in another order, leave the store the same.

    The runs that make up the store are listed in a manifest; each change writes the next one, by a rename that fails if somebody else was first.
    A reader sees the store before a change or after it; a job that dies between leaves files that no manifest names, which vacuum() removes.
    A store with a name lies in the shared folder: later applications open it by that name and find its messages. Without one it goes with the application.

    Keys: the columns of `key`, without blanks around and in lower case. A row with a null or blank key column is a message of its own: it is
    never a copy, and isn't stored. Rows without an `order` value can't be told apart and are left out. An empty batch makes an empty run.
    """

    def __init__(self, spark: SparkSession, key: Sequence[str], at: str, order: str, buckets: int | None = None, name: str | None = None):
        self.spark, self.key, self.at, self.order = spark, list(key), at, order
        self.keys = [f"_k{i}" for i in range(len(self.key))]
        self.place = f"{shared_dir(spark)}/messages/{name}" if name else f"{workspace(spark)}/messages_{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        said = self.manifest()
        self.buckets = said["buckets"] if said else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if said and said["key"] != self.key:
            raise ValueError(f"this store's key is {said['key']}")

    # The manifest: which runs make up the store.

    def _versions(self) -> list[int]:
        if not self._files.exists(self._path(self.place)):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(self.place))]
        return sorted(int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict | None:
        """What the store is made of at present; None if there is none yet."""
        at = self._versions()
        if not at:
            return None
        stream = self._files.open(self._path(f"{self.place}/manifest-{at[-1]:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": at[-1]}
        finally:
            stream.close()

    def runs(self) -> list[str]:
        said = self.manifest()
        return said["runs"] if said else []

    def _commit(self, before: dict | None, runs: list[str]) -> None:
        version = (before["version"] if before else 0) + 1
        draft = self._path(f"{self.place}/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps({"key": self.key, "buckets": self.buckets, "runs": runs}).encode()))
        stream.close()
        target = self._path(f"{self.place}/manifest-{version:08d}.json")
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise RuntimeError("the store has been changed by somebody else; open it again and repeat")

    # Runs.

    def _table(self, run: str) -> DataFrame:
        """A run, as a table that the catalog of this application knows to be bucketed and sorted."""
        if not self.spark.catalog.tableExists(run):
            columns = ", ".join(f"{k} string" for k in self.keys)
            by = ", ".join(self.keys)
            stamp = self.manifest_type()
            self.spark.sql(f"create table {run} ({columns}, _at {stamp}, _order bigint) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{self.place}/{run}'")
        return self.spark.table(run)

    def manifest_type(self) -> str:
        """The type of `at`, as the runs' files have it."""
        return self.spark.read.parquet(f"{self.place}/{self.runs()[0]}").schema["_at"].dataType.simpleString()

    def _write(self, df: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        df.write.option("path", f"{self.place}/{run}").option("compression", "zstd").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(run)
        return run

    def rows(self, batch: DataFrame) -> DataFrame:
        """The batch's keyed rows: the key's parts, when they were attempted and their order."""
        df = batch.select(*[folded(F.col(c)).alias(k) for c, k in zip(self.key, self.keys, strict=True)], F.col(self.at).alias("_at"), F.col(self.order).cast("long").alias("_order"))
        return df.where(" and ".join(f"{k} is not null and {k} <> ''" for k in self.keys) + " and _order is not null")

    @staticmethod
    def _rank(row: Column | None = None) -> Column:
        at, order = (F.col("_at"), F.col("_order")) if row is None else (row["_at"], row["_order"])
        return F.struct(at.isNull().alias("none"), at.alias("_at"), order.alias("_order"))

    def best(self, df: DataFrame) -> DataFrame:
        """One row for each key. The partial aggregate runs before any shuffle, so a message of a third of all rows sends one row a task."""
        return df.groupBy(*self.keys).agg(F.min(self._rank()).alias("_best")).select(*self.keys, "_best._at", "_best._order")

    def upsert(self, batch: DataFrame) -> MessageStore:
        before = self.manifest()
        run = self._write(self.best(self.rows(batch)).repartition(self.buckets, *self.keys))
        self._commit(before, [*(before["runs"] if before else []), run])
        return self

    def merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs as one, by a merge join along their buckets: both are read as they are sorted."""
        a, b = one.alias("a"), other.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in self.keys]
        left, right = (F.when(F.col(f"{x}.{self.keys[0]}").isNotNull(), F.struct(F.col(f"{x}._at").isNull().alias("none"), F.col(f"{x}._at").alias("_at"), F.col(f"{x}._order").alias("_order"))) for x in "ab")
        both = a.hint("merge").join(b, same, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self.keys], F.least(left, right).alias("_best"))
        return both.select(*self.keys, "_best._at", "_best._order")

    def compact(self) -> MessageStore:
        """Merges all runs into one, which then takes their place in the manifest. The files of the runs before stay for those who read them; vacuum() removes them."""
        before = self.manifest()
        runs = list(before["runs"]) if before else []
        if len(runs) < 2:
            return self
        setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # one file a bucket: the order in the file is the bucket's
        was = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "true")
        try:
            while len(runs) > 1:
                runs = [*runs[2:], self._write(self.merged(self._table(runs[0]), self._table(runs[1])))]
        finally:
            self.spark.conf.set(setting, was)
        self._commit(before, runs)
        return self

    def vacuum(self) -> None:
        """Removes what neither the manifest nor the one before it names. Not to be run while an upsert or compaction is under way."""
        at = self._versions()
        named: set[str] = set()
        for v in at[-2:]:
            stream = self._files.open(self._path(f"{self.place}/manifest-{v:08d}.json"))
            named |= {f"manifest-{v:08d}.json", *json.loads(bytes(stream.readAllBytes()).decode())["runs"]}
            stream.close()
        for x in self._files.listStatus(self._path(self.place)) if at else []:
            name = x.getPath().getName()
            if name not in named:
                if name.startswith("run_"):
                    self.spark.sql(f"drop table if exists {name}")
                self._files.delete(x.getPath(), True)

    def kept(self) -> DataFrame:
        """The copies to keep, over all runs."""
        runs = self.runs()
        if not runs:
            raise ValueError("nothing was ever upserted")
        if len(runs) == 1:
            return self._table(runs[0])
        return self.best(self.spark.read.schema(self._table(runs[0]).schema).parquet(*[f"{self.place}/{r}" for r in runs]))

    def drop(self) -> None:
        for r in self.runs():
            self.spark.sql(f"drop table if exists {r}")
        self._files.delete(self._path(self.place), True)

    def surplus(self, batch: DataFrame) -> DataFrame:
        """The `order` values of the batch's rows that aren't the copy to keep. Joined on `order`, which is unique, so no message is hot here."""
        return self.rows(batch).select("_order").join(self.kept().select("_order"), "_order", "left_anti").select(F.col("_order").alias(self.order))


def deduplicated(deliveries: DataFrame, key: Sequence[str], at: str, order: str, batch: str, upserts: int = 4) -> DataFrame:
    """The surplus copies of a table of deliveries, by a store of its own: its batches are upserted in order, in `upserts` ranges of batch numbers, and the runs merged by a compaction.

    A row without a batch number goes with the first range. An empty table gives no rows."""
    store = MessageStore(deliveries.sparkSession, key, at, order)
    number = F.col(batch).cast("long")
    lo, hi = deliveries.agg(F.min(number), F.max(number)).first()
    if lo is None:
        store.upsert(deliveries)
    else:
        step = (hi - lo) // upserts + 1
        for a in range(lo, hi + 1, step):
            mine = (number >= a) & (number < a + step)
            store.upsert(deliveries.where(mine | number.isNull() if a == lo else mine))
    return store.compact().surplus(deliveries)
