"""Size-tiered compaction of append-only shards under versioned manifests.

``append`` writes arrivals as they come, without a shuffle: every task writes small immutable shards of the arrivals it
holds, and an arrival is a run. ``compact`` merges: a run's tier is the logarithm of its size; any ``fan`` neighbouring
runs of one tier, in arrival order, become one run, until no tier holds as many. What to merge is worked out on the runs'
sizes first, so every byte is rewritten once however many tiers it climbs. A merged run is dealt evenly to files of about
``target_bytes`` (smaller ones where a run is small, so that ``least_files`` tasks can read it), one file a task; a bulk
load is no different from many small ones.

Rows are stored inside one column, so no name of theirs meets the store's own. A commit writes a whole manifest (a table:
one row an arrival, with its run and folder) and then publishes its name as a version: one file made in a step that fails
if the version exists. Of racing writers one wins and the others get an error; readers take the highest version and open
only the folders it names, so a lost job leaves nothing visible, and shards are never changed.

Defined cases: a null arrival key is the arrival -1; null sizes count nothing; empty appends add no runs and an empty
table gives an empty manifest; repeated rows stay; all columns are stored and come back, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "arrival bigint, run bigint, tier int, files int, n_rows bigint, n_bytes bigint, folder string, merged boolean"
PLACE = "arrival bigint, run bigint, file bigint"


class ShardStore:
    """A folder of runs with its manifests; every method is a Spark job over the data it names."""

    def __init__(self, spark: SparkSession, root: str, base_bytes: int = 1 << 20, fan: int = 4, target_bytes: int = 128 << 20, least_files: int = 16, most_tasks: int = 20_000):
        self.spark, self.root, self.base, self.fan, self.target, self.least, self.most = spark, root.rstrip("/"), base_bytes, fan, target_bytes, least_files, most_tasks
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest committed version, 0 if there is none."""
        top = self.path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return max([0, *(int(n) for n in names if n.isdigit())])

    def manifest(self) -> DataFrame:
        """The committed manifest, one row an arrival."""
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.root}/versions/{v}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, manifest: DataFrame, after: int) -> int:
        """Publishes the manifest as version after + 1; an error if another writer was faster."""
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        draft, final = self.path(f"{self.root}/versions/_{name}"), self.path(f"{self.root}/versions/{after + 1}")
        out = self.fs.create(draft)
        out.write(f"{name}\n".encode())
        out.close()
        try:
            self._publish(draft, final)
        except Exception as e:
            if self.fs.exists(final):
                raise RuntimeError(f"version {after + 1} was committed by another writer") from e
            raise
        return after + 1

    def _publish(self, draft, final) -> None:
        """Gives the draft its final name, in one step that fails if the name is taken: a link on a local file system
        (whose rename overwrites), elsewhere a rename without overwriting."""
        jvm = self.spark._jvm
        if self.fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(final), local(draft))
            return
        none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)

    def _tier(self, n_bytes: Column) -> Column:
        steps = F.ln(F.greatest(n_bytes, F.lit(1)) / float(self.base)) / F.ln(F.lit(float(self.fan)))
        return F.greatest(F.lit(0), F.floor(steps + 1e-9)).cast("int")

    def append(self, rows: DataFrame, arrival: Column, n_bytes: Column, after: int | None = None) -> int:
        """Writes every arrival (a bigint key that grows with time) as a run of its own and commits on top of ``after``."""
        v = self.version() if after is None else after
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        key = F.coalesce(arrival.cast("long"), F.lit(-1).cast("long"))
        kept = rows.select(key.alias("arrival"), F.coalesce(n_bytes, F.lit(0)).cast("long").alias("n_bytes"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
        kept.write.partitionBy("arrival").option("compression", "zstd").parquet(folder)
        stored = self.spark.read.schema("arrival bigint, n_bytes bigint").parquet(folder)
        runs = stored.groupBy("arrival").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        new = runs.select("arrival", F.col("arrival").alias("run"), self._tier(F.col("n_bytes")).alias("tier"), F.lit(0).alias("files"), "n_rows", "n_bytes", F.lit(folder).alias("folder"), F.lit(False).alias("merged"))
        old = self.manifest()
        clash = old.join(new.select("arrival"), "arrival", "left_semi")
        if not clash.isEmpty():
            raise ValueError("an arrival of this key is in the store already")
        return self.commit(old.unionByName(new), v)

    def plan(self) -> DataFrame:
        """The manifest's rows with the run, tier and files that compaction gives them, and was: their run until now.

        Each round numbers the runs of a tier in arrival order and joins full groups of ``fan`` neighbours; a merged run
        is known by its first arrival. The manifest is metadata: a row an arrival.
        """
        held = self.manifest()
        runs = held.groupBy("run").agg(F.min("tier").alias("tier"), F.sum("n_bytes").alias("run_bytes")).withColumn("to", F.col("run"))
        names = runs.select("run", "to")
        level = runs.select(F.col("to").alias("run"), "tier", "run_bytes")
        while not level.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan).isEmpty():
            group = F.floor((F.row_number().over(W.partitionBy("tier").orderBy("run")) - 1) / self.fan)
            put = level.withColumn("grp", group)
            full = F.count("*").over(W.partitionBy("tier", "grp")) == self.fan
            put = put.select("run", "tier", "run_bytes", F.when(full, F.min("run").over(W.partitionBy("tier", "grp"))).otherwise(F.col("run")).alias("to"))
            # at least one tier higher, so that rounds end even where sizes differ
            level = put.groupBy("to").agg(F.sum("run_bytes").alias("run_bytes"), F.max("tier").alias("was"), F.count("*").alias("n"))
            tier = F.when(F.col("n") > 1, F.greatest(self._tier(F.col("run_bytes")), F.col("was") + 1)).otherwise(F.col("was")).cast("int")
            level = level.select(F.col("to").alias("run"), tier.alias("tier"), "run_bytes")
            names = names.join(put.select(F.col("run").alias("to"), F.col("to").alias("next")), "to").select("run", F.col("next").alias("to"))
        size = F.least(F.lit(self.target), F.ceil(F.greatest(F.col("run_bytes"), F.lit(1)) / F.lit(float(self.least))))
        files = F.greatest(F.lit(1), F.ceil(F.col("run_bytes") / size)).cast("int").alias("files")
        placed = held.drop("tier", "files").withColumnRenamed("run", "was").join(names.withColumnRenamed("run", "was"), "was").join(level.select(F.col("run").alias("to"), "tier", files), "to")
        return placed.select("arrival", F.col("to").alias("run"), "tier", "files", "n_rows", "n_bytes", "folder", "merged", "was")

    def compact(self, spread: Column | None = None) -> int:
        """Rewrites what the plan moves into target-sized files and commits; runs that stay are not touched.

        A row's file within its run is a number drawn from ``spread``, an expression over the rows' columns; else from
        the whole row.
        """
        v, folder, draft = self.version(), f"{self.root}/data/{uuid.uuid4().hex}", f"{self.root}/plans/{uuid.uuid4().hex}"
        own = W.partitionBy("run")
        self.plan().withColumn("stays", F.min("was").over(own) == F.max("was").over(own)).write.parquet(draft)
        plan = self.spark.read.parquet(draft)
        moved = plan.where("not stays")
        if moved.isEmpty():
            return v
        runs = moved.groupBy("run").agg(F.max("files").alias("files"))
        slots = runs.withColumn("first", F.sum("files").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["first"])
        total = runs.agg(F.sum("files")).first()[0]
        rows = self._stored(moved.select(*self.manifest().columns[:1], "folder", "merged", F.col("was").alias("run"))).select("arrival", "n_bytes", "row")
        rows = rows.join(moved.select("arrival", "run"), "arrival").join(slots, "run")
        drawn = F.pmod(F.xxhash64("row") if spread is None else spread, F.col("files"))
        rows = rows.withColumn("file", drawn.cast("long")).withColumn("slot", (F.col("first") + F.col("file")).cast("long"))
        # one task a file; beyond most_tasks a task writes several, one after the other
        tasks = int(min(total, self.most))
        dealt = rows.repartitionById(tasks, F.pmod("slot", F.lit(tasks)).cast("int"))
        dealt.select("n_bytes", "row", "arrival", "run", "file").write.partitionBy("run", "file").option("compression", "zstd").parquet(folder)
        new = moved.withColumn("folder", F.lit(folder)).withColumn("merged", F.lit(True)).drop("stays", "was")
        kept = self.manifest().join(plan.where("stays").select("arrival"), "arrival", "left_semi")
        return self.commit(kept.unionByName(new.select(*kept.columns)), v)

    def _stored(self, manifest: DataFrame) -> DataFrame:
        """arrival, run, file (null before a merge), n_bytes and row of the manifest's arrivals.

        Commits, not runs, are folders to open: no tier keeps ``fan`` runs, so few commits are alive after compaction.
        """
        found = None
        for folder, merged in sorted(tuple(r) for r in manifest.select("folder", "merged").distinct().collect()):
            alive = manifest.where(F.col("folder") == folder)
            rows = self.spark.read.parquet(folder)
            if merged:
                rows = rows.join(alive.select("run").distinct(), "run").withColumn("arrival", F.col("arrival").cast("long"))
            else:
                rows = rows.join(alive.select("arrival", "run"), "arrival").withColumn("file", F.lit(None).cast("long"))
            rows = rows.select(F.col("arrival").cast("long").alias("arrival"), F.col("run").cast("long").alias("run"), F.col("file").cast("long").alias("file"), "n_bytes", "row")
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    def located(self) -> DataFrame:
        """row (a struct of the columns appended) and place (arrival, run and file: null before a merge) of all rows."""
        held = self.manifest()
        if held.isEmpty():
            return self.spark.createDataFrame([], f"row struct<nothing:int>, place struct<{PLACE}>")
        return self._stored(held).select("row", F.struct("arrival", "run", "file").alias("place"))

    def read(self) -> DataFrame:
        """All rows of the committed version, with the columns they came with."""
        return self.located().select("row.*")
