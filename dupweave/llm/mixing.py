"""Mixing sources to target weights by systematic sampling.

Targets: the mix holds `share` times all words. Sources in code point order (null last) weigh 5, 2, 1,
repeating; a source's target stops at `cap` times its size and the excess goes to the others by weight
until none is above. Sampling: the documents of a source stand in a fixed order and each expects
target / size copies; the running sum of these, started at one random offset of the source, makes a
document appear once for each integer boundary that its step crosses. So a document gets the floor or
the ceiling of the rate. The order goes up by size through one half of a source's documents and down
through the other, halves being a bit of the id's hash: short documents stand at both ends, so the offset
shifts words between neighbours of like size and the words taken stay near the target.

The running sum is split in two, for a source may hold any share of all rows: a cell is (source, size
band, hash bucket); cells are counted with map-side combining, the counts are summed up in order over a source's bands
(some 120 rows) and over a band's cells (16 ** CELL_DIGITS at most), and rows are numbered only within their cell. The
targets take one row a source.

Defined results: null text has size 0; a null source is a source of its own, last in order; repeated
rows are separate rows (each is sampled); ties in size are ordered by a hash of the id, then by the text's digest and
by a hash of the other columns (map columns apart), so that reruns emit the same; rows that are equal in all of these share
their copies in any order; an empty table gives an empty result; input
columns named like the output columns are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import fresh, hex_fraction, ref, row_key
from .words import words_per_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: The random offset of a source is a multiple of this, so that sums at a rate of 1 or 2 are exact.
OFFSET_STEPS = 1 << 20
CELL_DIGITS = 3
#: Hash buckets below this stand in rising, the others in falling order of size.
HALF = "8" + "0" * (CELL_DIGITS - 1)


@F.arrow_udf(LongType())
def _words(texts: pa.Array) -> pa.Array:
    return pa.array(words_per_text(texts), pa.int64())


def word_count(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII white-space characters; null: 0."""
    return _words(F.coalesce(text, F.lit("")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size) -> (key, source_size, target). One row a source; `key` sorts as the source does."""
    number = F.row_number().over(Window.orderBy("key"))
    weighed = sizes.withColumn("n", number).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") - 1) % len(weights) + 1))
    everywhere = Window.partitionBy()
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "key")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everywhere) * F.lit(share)
    level = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.select("key", "source_size", "weight", "most", "ratio", F.row_number().over(by_ratio).alias("at"), level.alias("level"))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(everywhere)
    return levelled.withColumn("found", first["level"]).select("key", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("found"), F.col("most"))).alias("target"))


def _drawn(docs: DataFrame, weights, share: float, cap: float, seed: str, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, dict[str, Column], list[Column]]:
    """Rows with private columns added, the results by name, and the columns of `docs`.

    Two scans: one for the cells' counts, one that shuffles each row once by its cell; the cells' table
    is hashed by the same three columns, so the join and the numbering use one exchange of the rows.
    """
    p = fresh(docs, "m")
    key = F.when(ref(source_col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), ref(source_col).cast("string")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_key(id_col, text_col)))
    rows = docs.withColumn(f"{p}key", key).withColumn(f"{p}size", word_count(ref(text_col))).withColumn(f"{p}hash", digest)
    rows = rows.withColumn(f"{p}band", F.floor(F.log2(F.col(f"{p}size") + 1) * 8 + F.lit(1e-9))).withColumn(f"{p}cell", F.substring(f"{p}hash", 1, CELL_DIGITS))

    cells = rows.groupBy(F.col(f"{p}key").alias("key"), F.col(f"{p}band").alias("band"), F.col(f"{p}cell").alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.sum(f"{p}size").alias("words")).withColumn("falls", F.col("cell") >= HALF)
    # Sums in two steps: over a source's bands, of which there are few, then over a band's cells.
    bands = cells.groupBy("key", "falls", "band").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    targets = source_targets(bands.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    earlier = lambda window: F.coalesce(F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("key", "falls", "band", earlier(Window.partitionBy("key").orderBy("falls", F.when(F.col("falls"), -F.col("band")).otherwise(F.col("band")))).alias("before_band"))
    up = lambda cell, value: F.when(cell < HALF, value).otherwise(-value)
    offset = hex_fraction(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.col("key"))), 1, 5) / F.lit(float(OFFSET_STEPS))
    placed = cells.withColumn("inside", earlier(Window.partitionBy("key", "falls", "band").orderBy("cell"))).join(bands, ["key", "falls", "band"]).join(targets, "key")
    placed = placed.withColumn("before", F.col("before_band") + F.col("inside")).withColumn("offset", offset)
    placed = placed.select(*[F.col(c).alias(f"{p}c_{c}") for c in ("key", "band", "cell", "before", "source_size", "target", "offset")])

    plain = [ref(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    within = Window.partitionBy(f"{p}key", f"{p}band", f"{p}cell").orderBy(up(F.col(f"{p}cell"), F.col(f"{p}size")), f"{p}hash", ref(id_col), F.md5(F.coalesce(ref(text_col), F.lit(""))), F.xxhash64(*plain))
    same = [F.col(f"{p}{c}") == F.col(f"{p}c_{c}") for c in ("key", "band", "cell")]
    numbered = rows.withColumn(f"{p}n", F.row_number().over(within)).join(placed, same)
    source_size, target, size = F.col(f"{p}c_source_size"), F.col(f"{p}c_target"), F.col(f"{p}size")
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    rank = F.col(f"{p}c_before") + F.col(f"{p}n")
    crossed = F.floor(F.col(f"{p}c_offset") + rate * rank) - F.floor(F.col(f"{p}c_offset") + rate * (rank - 1))
    copies = F.least(F.greatest(crossed, F.lit(0)), F.ceil(rate)).cast("long")
    return numbered, {"size": size, "source_size": source_size, "target": target, "copies": copies, "taken": size * copies}, [ref(c) for c in docs.columns]


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with `size`, `source_size`, `target`, `copies` and `taken` (size times copies)."""
    rows, results, columns = _drawn(docs, weights, share, cap, seed, id_col, text_col, source_col)
    kept = [c for c, name in zip(columns, docs.columns, strict=True) if name.lower() not in results]
    return rows.select(*kept, *[value.alias(name) for name, value in results.items()])


def emit_copies(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of `docs` as often as it was drawn, with the columns of `docs`."""
    rows, results, columns = _drawn(docs, weights, share, cap, seed, id_col, text_col, source_col)
    n = fresh(rows, "copies")
    drawn = rows.withColumn(n, results["copies"]).filter(F.col(n) > 0)
    return drawn.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*columns)


def mix_sql(rows: str = "documents", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> str:
    """DuckDB SQL for the columns of the query: one global numbering a source instead of cells."""
    return f"""
WITH sized AS (
  SELECT *, CASE WHEN source IS NULL THEN '~' ELSE 's' || source END AS key,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))) AS h FROM {rows}),
per AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (SELECT *, ([{",".join(str(float(w)) for w in weights)}]::DOUBLE[])[((row_number() OVER (ORDER BY key) - 1) % {len(weights)} + 1)::BIGINT] AS weight FROM per),
bounded AS (SELECT *, source_size * {cap}::DOUBLE AS most, source_size * {cap}::DOUBLE / weight AS ratio, sum(source_size) OVER () * {share}::DOUBLE AS wanted FROM weighed),
levelled AS (SELECT *, row_number() OVER o AS place,
  (wanted - coalesce(sum(most) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bounded WINDOW o AS (ORDER BY ratio, key)),
found AS (SELECT arg_min(level, place) AS level FROM levelled WHERE ratio >= level),
targets AS (SELECT key, source_size, least(most, coalesce(weight * (SELECT level FROM found), most)) AS target,
  CAST(('0x' || substr(md5('{seed}:offset:' || key), 1, 5)) AS BIGINT) / {float(OFFSET_STEPS)}::DOUBLE AS o FROM levelled),
ranked AS (SELECT s.*, t.source_size, t.target, t.o, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY s.key ORDER BY substr(s.h, 1, {CELL_DIGITS}) >= '{HALF}', CASE WHEN substr(s.h, 1, {CELL_DIGITS}) < '{HALF}' THEN 1 ELSE -1 END * floor(log2(s.size + 1) * 8 + 1e-9), substr(s.h, 1, {CELL_DIGITS}),
    CASE WHEN substr(s.h, 1, {CELL_DIGITS}) < '{HALF}' THEN 1 ELSE -1 END * s.size, s.h, s.doc_id, md5(coalesce(s.text, ''))) AS n
  FROM sized s JOIN targets t ON s.key = t.key),
drawn AS (SELECT *, least(greatest(floor(o + rate * n) - floor(o + rate * (n - 1)), 0), ceil(rate))::BIGINT AS copies FROM ranked)"""


def mix_query_sql(**options) -> str:
    return mix_sql(**options) + "\nSELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM drawn"
