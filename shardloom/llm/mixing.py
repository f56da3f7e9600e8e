"""Mixing sources to target weights by capped water-filling.

Each source wants a share of the total size in proportion to its weight, but may be repeated at most
`max_epochs` times.  Sources whose share is above their cap are clamped there, and what is left is shared
again by weight among the others until no share is above its cap.  With the sources sorted by
cap / weight the clamped ones are a prefix, so the fixed point of those rounds is found with two running
sums over one row per source.

A source's documents are then taken floor(target / size) times whole, and the fraction that remains is a
seeded sample of whole documents: in the order of a seeded hash of doc_id and text, documents are taken until the
fraction's words are reached, so that each source ends within one document of its target.  The cut is found from a
histogram of the hash (4,096 bins a source), and only the different hashes in the cut's own bin are sorted: no
source is ever gathered in one task.  What is found is one row a source, its cut, and every row is then judged by itself.

Defined cases: a null text is an empty one and has size 0; a null source is a source of its own, after all others; an empty
table gives no rows; rows of one doc_id, or without one, are told apart by their texts, and of rows that are the same in
both, which share a hash, as many are taken as fit; documents of size 0 take 0 words; a very long text is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, small

MAX_EPOCHS = 3.0
SEED = 17
#: Hexadecimal digits of the hash that number the histogram's bins.
BIN_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, max_epochs: float = MAX_EPOCHS, weights: Column | None = None) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = weights if weights is not None else ((F.row_number().over(order) - 1) % 3 + 1).cast("double")
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "_free": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    per = per.withColumn("_level", F.col("_free") / F.col("_left"))
    # the first source in order that stays under its cap sets the level for it and all after it
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))).select("source", "source_size", "target")


def mix(docs: DataFrame, size: Column | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with added columns size, source_size, target, repeats and taken (words, repeats counted).

    size: a row's size, by default the words of its text.  docs needs doc_id and source; a column `_content` (a hash of the text) tells
    rows of one doc_id apart, and is made from the text where it is missing.  Columns of the added names that the input may have are replaced.
    """
    content = F.col("_content") if "_content" in docs.columns else F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), content).cast("binary"))
    rows = docs.withColumn("_content", content).withColumn("size", size_of(F.col("text")) if size is None else size).withColumn("_h", hashed)
    plan = cuts(rows.select("source", "size", "_h"), max_epochs)
    taken = rows.drop("source_size", "target", "repeats", "taken", "_content").join(small(plan), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # of rows that are the same in everything some may be taken and others not: those are numbered, task by task
    torn = F.col("_h").eqNullSafe(F.col("_cut")) & (F.col("_copies") < F.col("_ties"))
    sure = taken.where(~torn).withColumn("_extra", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)).cast("long"))
    tied = taken.where(torn).withColumns({"_task": F.shiftright(F.monotonically_increasing_id(), 33), "_name": F.md5(F.to_json(F.struct("_h", "source")).cast("binary"))})
    tasks = tied.groupBy("_name", "_task").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_name").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("_name").alias("_k"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("_name", "_task").orderBy(F.lit(0))) + F.col("_ahead")
    tied = tied.join(tasks, (F.col("_name") == F.col("_k")) & (F.col("_task") == F.col("_t"))).withColumn("_extra", (nth <= F.col("_copies")).cast("long"))
    both = sure.unionByName(tied.drop("_task", "_name", "_k", "_t", "_ahead"))
    both = both.withColumn("repeats", F.least(F.col("_whole") + F.col("_extra"), F.lit(int(max_epochs))))
    return both.withColumn("taken", F.col("repeats") * F.col("size")).drop("_h", "_whole", "_cut", "_copies", "_ties", "_extra")


def cuts(rows: DataFrame, max_epochs: float) -> DataFrame:
    """(source, size, _h) to one row a source: _s, source_size, target, _whole, and the hash _cut up to which a further copy is taken.

    Of the _ties rows whose hash is _cut itself, _copies are taken.
    """
    bins = materialise(rows.groupBy("source", F.substring("_h", 1, BIN_DIGITS).alias("_bin")).agg(F.sum("size").alias("size")), "mix-bins")
    goal = targets(bins.select("source", "size"), max_epochs).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_s")
    # the bin of the cut: the first whose words reach what is still wanted
    ahead = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = bins.withColumn("_upto", F.sum("size").over(ahead)).join(goal.select("_s", "_rest"), F.col("source").eqNullSafe(F.col("_s")))
    reached = upto.where(F.col("_upto") >= F.col("_rest")).groupBy("_s").agg(F.min(F.struct("_bin", (F.col("_rest") - F.col("_upto") + F.col("size")).alias("_room"))).alias("_b"))
    reached = small(materialise(reached.select(F.col("_s").alias("_r"), "_b._bin", "_b._room"), "mix-reached"))
    # only there does the order of documents count; rows of one hash are one row of theirs
    within = rows.withColumn("_at", F.substring("_h", 1, BIN_DIGITS)).join(reached, F.col("source").eqNullSafe(F.col("_r")) & (F.col("_at") == F.col("_bin")))
    within = within.groupBy("_r", "_room", "_bin", "_h").agg(F.count("*").alias("_ties"), F.max("size").alias("size"))
    run = Window.partitionBy("_r").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_room") - F.coalesce(F.sum(F.col("size") * F.col("_ties")).over(run), F.lit(0))
    # a document is taken when at least half of it fits
    copies = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("_ties")).otherwise(F.lit(0)))
    within = within.withColumn("_copies", F.least(F.greatest(copies, F.lit(0)), F.col("_ties")).cast("long"))
    last = within.where("_copies > 0").groupBy("_r").agg(F.max(F.struct("_h", "_copies", "_ties")).alias("_c"))
    found = reached.join(last.withColumnRenamed("_r", "_l"), F.col("_r").eqNullSafe(F.col("_l")), "left")
    # where no row of the bin is taken, all bins before it are
    found = found.select("_r", F.coalesce("_c._h", "_bin").alias("_cut"), F.coalesce("_c._copies", F.lit(0)).alias("_copies"), F.coalesce("_c._ties", F.lit(0)).alias("_ties"))
    every = goal.join(found, F.col("_s").eqNullSafe(F.col("_r")), "left")
    return materialise(every.select("_s", "source_size", "target", "_whole", "_cut", F.coalesce("_copies", F.lit(0)).cast("long").alias("_copies"), F.coalesce("_ties", F.lit(0)).cast("long").alias("_ties")), "mix-plan")


def op2_query(docs: DataFrame) -> DataFrame:
    content = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sized = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), content.alias("_content")), "sizes")  # the texts are read once
    return mix(sized, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def stage(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken, its columns unchanged."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    mixed = mix(rows).where("repeats > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM w),
v AS (SELECT arg_min(free / lft, cap / w) AS level FROM r WHERE free / lft * w <= cap),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM r, v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(least(whole + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM x
"""
