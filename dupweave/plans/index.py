"""An index of files as a table, and checks of edits against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import fingerprints, maintenance, matches
from ..sources.config import Options

def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables, if it's there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


EDIT = "edit_id long, session string, seq long, file string, format string, before string, before_kind string, before_path string, after string"


class DuplicateIndex:
    """Token streams of files, kept as one table; every change makes a new table from the old one.

    Tables are written under `folder` (a path that all executors see) and read back, so lineage stays short and a
    lost executor costs nothing; without a folder the plan is kept as it is, for small inputs.
    """

    def __init__(self, spark: SparkSession, options: Options | None = None, folder: str | None = None):
        self.spark, self.options, self.folder, self.version = spark, options or Options(), folder, 0
        context = spark.sparkContext
        if folder and not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(f"{folder}/checkpoints")
        self.tokens = spark.createDataFrame([], "file string, hashes array<long>, start_lines array<int>, end_lines array<int>")

    def _keep(self, tokens: DataFrame) -> None:
        """Write a new version. The one before stays, for results that aren't read yet; older ones go."""
        self.version += 1
        if self.folder:
            path = f"{self.folder}/v{self.version}"
            tokens.write.mode("overwrite").parquet(path)
            tokens = self.spark.read.parquet(path)
            drop_folder(self.spark, f"{self.folder}/v{self.version - 2}")
        self.tokens = tokens

    def verdicts(self, files: DataFrame) -> DataFrame:
        """files (file, text, ...) with format and the reason to skip them, if any: the path's before the content's."""
        judged = self.path_verdicts(files)
        return judged.withColumn("skip_reason", F.coalesce("reason", paths.skip_reason(F.col("text")))).drop("reason")

    def path_verdicts(self, files: DataFrame) -> DataFrame:
        """files (file, ...) with format and the path's reason against them, if any."""
        o = self.options
        verdict = paths.path_verdict(F.col("file"), list(o.ignore_patterns), o.ignore_tests, list(o.custom_test_patterns), list(o.exclude_test_patterns), o.formats_exts)
        return files.withColumn("_v", verdict).select(*[F.col(c) for c in files.columns if c not in ("format", "reason")], "_v.*")

    def _streams(self, files: DataFrame) -> DataFrame:
        """Token rows of files (file, format, text); equal contents are tokenized once."""
        keyed = files.withColumn("content_key", maintenance.content_key(F.col("format"), F.col("text")))
        contents = maintenance.distinct_contents(files).select(F.col("content_key").alias("file"), "format", "text")
        streams = fingerprints.token_table(contents).withColumnRenamed("file", "content_key")
        return keyed.select("file", "content_key").join(streams, "content_key").select("file", "hashes", "start_lines", "end_lines")

    def put(self, files: DataFrame) -> None:
        """Add or replace files (file, format, text)."""
        self._keep(maintenance.upsert(self.tokens, self._streams(files)))

    def change(self, files: DataFrame, gone: DataFrame) -> None:
        """Add or replace `files` and remove `gone` in one new version; none if both are empty."""
        if not (files.isEmpty() and gone.isEmpty()):
            self._keep(maintenance.upsert(maintenance.delete(self.tokens, gone), self._streams(files)))

    def remove(self, files: DataFrame) -> None:
        self._keep(maintenance.delete(self.tokens, files))

    def get(self, file: str) -> DataFrame:
        return self.tokens.filter(F.col("file") == file)

    def check(self, edits: DataFrame) -> DataFrame:
        """What each edit duplicates anew; all edits see the index as it is now."""
        return matches.new_duplicates(edits, self.tokens, self.options.min_tokens, self.options.min_lines)

    def check_in_order(self, edits: DataFrame) -> DataFrame:
        """As check(), but each edit sees the files as earlier edits left them. edits: EDIT.

        Edits with one number in order are checked together, so a batch needs as many steps as its longest session has
        edits; numbers are few by design (a micro-batch), and only they reach the driver.
        """
        found = None
        for row in edits.select("seq").distinct().orderBy("seq").toLocalIterator():
            step = edits.filter(F.col("seq") == row["seq"])
            # Made before the index moves on and cut from its version, as that one goes when two more are written.
            result = self.check(step).checkpoint() if self.folder else self.check(step)
            found = result if found is None else found.unionByName(result)
            self.put(step.select("file", "format", F.col("after").alias("text")))
        return found if found is not None else self.check(edits)
