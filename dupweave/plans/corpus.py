"""The driver's tables as files and edits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fingerprints, runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """`df` written once in the checkpoint folder, for plans that read it several times."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dupweave-checkpoint-"))
    return df.checkpoint()


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of all documents, made once."""
    return kept(fingerprints.token_table(document_files(spark, sf_dir)))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, format, text): every document, as prose."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.lit("txt").alias("format"), "text")


def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("file"), F.lit("txt").alias("format"), "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files of a block format."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("file"), F.lit("markup").alias("format"), F.col("html").alias("text"))


def conversation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an edit that appends the turn and a document to the text before it, within its conversation's file."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 8 + F.col("turn")).alias("at"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 8).alias("pasted_at"), F.col("text").alias("pasted"))
    # Only turns that can have a document, and documents that one can have, are shuffled for it.
    can = F.coalesce(F.col("at") % 8 == 0, F.lit(False))
    docs = runs.among(docs, "pasted_at", turns.filter(can).select("at"))
    with_doc = turns.filter(can).join(docs, F.col("at") == F.col("pasted_at"), "left").select(*turns.columns, "pasted")
    rows = with_doc.unionByName(turns.filter(~can).withColumn("pasted", F.lit(None).cast("string"))).withColumn("own", F.concat_ws("\n", "text", "pasted"))
    before = F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("edit_id"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("file"), F.lit("txt").alias("format"), before.alias("before"), F.lit(None).cast("string").alias("before_path"), F.concat_ws("\n", before, F.col("own")).alias("after"))
    return rows.withColumn("before_kind", F.when(F.col("before").isNull(), "absent").otherwise("content"))


#: Paths with what is known about them: for predicates that the tables' own paths don't reach.
PATHS = """src/app.ts src/app.test.ts src/__tests__/a.js tests/README.md lib/Foo.Tests/a.cs MyAppTests/Login.swift src/test/java/A.java
src/latest.ts src/contest.py test_auth.py TestUser.java ITOrder.java UserServiceTest.kt PaymentIT.java sort_bench.go a.min.js yarn.lock
node_modules/x/index.js dist/app.js docs/guide.md icon.svg page.html style.css data.json a/b/c/deep.rs .DS_Store src/a.generated.ts
run.bats x.snap conftest.py spec/models/user.rb e2e/login.ts Makefile noext .hidden src/.env.js ../up.ts ./here.ts /abs.ts dir/ . ..
src/attested.ts my.spec.tsx SRC/UPPER.PY lib/Cart.Spec.cs cypress/a.js Pods/x.m vendor/y.go out/z.ts src/util.cy.js latent.rb
src/vue/App.vue a.R b.r x.H deploy.sh main.zig schema.sql test.go tests.go Test.java IT.java IT9.java""".split()


def path_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): the documents' paths, the pages' and the list above."""
    listed = spark.range(1).select(F.explode(F.split(F.lit("\n".join(PATHS)), "\n")).alias("path"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"))
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return listed.unionByName(docs).unionByName(pages)
