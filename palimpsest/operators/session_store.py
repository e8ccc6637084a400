"""Sessions whose tables appear together or not at all: data first, then one rename of a manifest.

A commit writes each table into a folder of its own (`tables/<name>/commit=<id>`), which nobody reads yet, and then a manifest: for each session that it is about, which commit
now holds it, or that it is deleted. Manifests are folders numbered from 0; a rename that fails where the name is taken publishes one, so of two writers one takes the next
number and none is lost. Readers follow the manifests: a session is what the last manifest that names it says, in all tables at once.

Deleting, retention and replacing only write manifests; `vacuum` removes the folders that no live session is in any more. A commit may hold many sessions, so small ones don't become small files.

Cases: a commit that fails before its rename shows nothing; what it has written goes with vacuum once it is old enough not to be under way. Sessions that are committed again replace all their tables: one that the
new commit doesn't have is empty for them. An id that isn't there can be deleted. A store without manifests is empty. Null session ids aren't sessions.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = "session_id string, commit string, created_at timestamp"


class SessionStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    def _listed(self, folder: str) -> list:
        where = self._path(f"{self.path}/{folder}")
        return list(self._files.listStatus(where)) if self._files.exists(where) else []

    def _publish(self, rows: DataFrame) -> int:
        """The number of the manifest that rows (session_id; commit, null if deleted) have become."""
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.where("session_id IS NOT NULL").select("session_id", "commit", F.current_timestamp().alias("created_at")).write.parquet(staged)
        self._files.mkdirs(self._path(f"{self.path}/manifests"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.spark.sparkContext._gateway.new_array(rename, 1)
        plain[0] = rename.NONE
        while True:
            number = max((int(s.getPath().getName().partition("=")[2]) for s in self._listed("manifests")), default=-1) + 1
            try:
                context.rename(self._path(staged), self._path(f"{self.path}/manifests/seq={number}"), plain)
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
            else:
                return number

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables' rows (all with session_id) and publishes the sessions of the table `sessions`."""
        commit = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/tables/{name}/commit={commit}")
        written = self.spark.read.parquet(f"{self.path}/tables/sessions/commit={commit}")
        return self._publish(written.select(F.col("session_id").cast("string").alias("session_id")).distinct().withColumn("commit", F.lit(commit)))

    def _log(self) -> DataFrame:
        if not self._listed("manifests"):
            return self.spark.createDataFrame([], MANIFEST + ", seq int")
        return self.spark.read.schema(MANIFEST + ", seq int").parquet(f"{self.path}/manifests")

    def live(self) -> DataFrame:
        """session_id and the commit that holds it; seq and created_at of the manifest that said so."""
        last = self._log().groupBy("session_id").agg(F.max_by(F.struct("commit", "created_at"), "seq").alias("last"), F.max("seq").alias("seq"))
        return last.where("last.commit IS NOT NULL").select("session_id", "last.commit", "seq", "last.created_at")

    def table(self, name: str) -> DataFrame:
        """The rows of all live sessions."""
        if not self._listed(f"tables/{name}"):
            return self.spark.createDataFrame([], StructType([StructField("session_id", StringType())]))
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/tables/{name}").parquet(f"{self.path}/tables/{name}")
        held = self.live().select(F.col("session_id").alias("_session"), F.col("commit").alias("_commit"))
        return rows.join(held, (F.col("session_id").cast("string") == F.col("_session")) & (F.col("commit").cast("string") == F.col("_commit")), "left_semi").drop("commit")

    def delete(self, sessions: DataFrame | None = None) -> int:
        """Of the sessions (session_id), or of all, everything goes at once."""
        gone = self.live().select("session_id") if sessions is None else sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct()
        return self._publish(gone.withColumn("commit", F.lit(None).cast("string")))

    def retain(self, newest: int) -> int:
        """Keeps the sessions committed last, by manifest and then by id, and deletes the others. The rank of the last one kept is found from counts by manifest, not by sorting all."""
        live = self.live()
        counts = live.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("seq"))
        kept, border = 0, None
        for r in counts.toLocalIterator():
            if kept + r.n > newest:
                border = r.seq
                break
            kept += r.n
        if border is None:
            return self._publish(live.select("session_id", F.lit(None).cast("string").alias("commit")).limit(0))
        stay = live.where(F.col("seq") == border).orderBy("session_id").limit(newest - kept).select("session_id")
        gone = live.where(F.col("seq") <= border).join(stay, "session_id", "left_anti")
        return self._publish(gone.select("session_id", F.lit(None).cast("string").alias("commit")))

    def vacuum(self, unpublished_hours: float = 24.0) -> list[str]:
        """Removes the folders of commits that no live session is in, and of those never published that are older than that; returns their ids."""
        live = {r.commit for r in self.live().select("commit").distinct().toLocalIterator()}
        published = {r.commit for r in self._log().where("commit IS NOT NULL").select("commit").distinct().toLocalIterator()}
        oldest, gone = (time.time() - 3600 * unpublished_hours) * 1000, set()
        for name in [s.getPath().getName() for s in self._listed("tables")]:
            for folder in self._listed(f"tables/{name}"):
                commit = folder.getPath().getName().partition("=")[2]
                if commit not in live and (commit in published or folder.getModificationTime() < oldest):
                    self._files.delete(folder.getPath(), True)
                    gone.add(commit)
        for folder in self._listed("staging"):
            if folder.getModificationTime() < oldest:
                self._files.delete(folder.getPath(), True)
        return sorted(gone)
