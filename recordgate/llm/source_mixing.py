"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key -ln(u) / quality with u from a hash of its id, so
reruns agree.  A source's target is met by complete epochs (every document, as often
as the target holds the source whole) and then by the documents with the least keys
up to the rest of the target.

Prefix sums over a source are made in steps so that no task holds a source: rows are dealt by
ranges of (source, key), which Spark cuts by quantiles of these, and each range is cut into slices of
so many rows in their order.  Ranges are added up first, then slices inside their range, and rows only in
the slices in which the rest runs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, key_kinds, parts_for, staged, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times the size of its source.
MOST_EPOCHS = 3
#: Quality weights of documents labelled good, bad, or not at all.
QUALITY = {"good": 1.0, "bad": 0.25, "none": 0.5}
#: Rows of one range, which a task puts in order, and of one slice of it.
RANGE_ROWS, SLICE_ROWS = 200_000, 500


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def uniform(column: Column, salt: str) -> Column:
    """In (0, 1), from the first 52 bits of an md5 of the value's text; null counts as the empty text."""
    digest = F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(salt)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST_EPOCHS) -> DataFrame:
    """(source, size) rows -> a row per source: source, source_size, target.

    Water filling in closed form: sources in order of cap per weight; a source is
    held at its cap as long as sharing what is left by weight would exceed it.  The
    window runs over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * F.lit(float(most))
    tight = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = (
        by_source.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("held", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("held_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("held")) / (F.col("weights") - F.col("held_weight")))
        # The first source that is not at its cap has the highest level of those; it holds for all after it.
        .withColumn("free_level", F.max(F.when(F.col("level") * F.col("weight") < cap, F.col("level"))).over(every))
    )
    target = F.when(F.col("free_level").isNull(), cap).otherwise(F.least(cap, F.col("free_level") * F.col("weight")))
    return spread.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, most=MOST_EPOCHS, salt: str = "mix") -> DataFrame:
    """docs (doc_id, source, text, ...) -> row for row: doc_id, source, size, source_size, target, taken.

    size: words of the text; null and empty texts have 0 and take 0 words.  quality
    (doc_id, quality): a weight over 0 for a document; the mean of repeated rows
    holds, and documents without one get ``QUALITY["none"]``.  Null sources are one
    source, the last.  Ties in the key go to the smaller doc_id, nulls first, then
    the smaller size; rows alike in all of these may stand for each other.  The
    document at the edge of the target is taken if that brings the sum nearer to it.
    A source without words has target 0; no rows give no rows.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text_or_empty()).alias("size"))
    if quality is not None:
        known = quality.where("quality > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
        sized = sized.join(known, "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(None).cast("double"))
    key = -F.log(uniform(F.col("doc_id"), salt)) / F.coalesce("quality", F.lit(QUALITY["none"]))
    # The tie lets rows that are alike in all else lie in several ranges.
    keyed = staged(sized.select("doc_id", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("tie")), "mix-keys")
    order = [F.col("source").asc_nulls_last(), "key", "doc_id", "size", "tie"]
    ranges = keyed.repartitionByRange(parts_for(keyed.count(), RANGE_ROWS), *order).sortWithinPartitions(*order).drop("tie")
    # The id is the range, and the row's place in it in the lower 33 bits, so slices are in order and none spans two ranges.
    keyed = staged(ranges.withColumn("at", F.monotonically_increasing_id()), "mix-order")
    keyed = keyed.withColumn("slice", F.floor(F.col("at") / SLICE_ROWS).cast("long"))
    targets = source_targets(keyed, weights, most).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    targets = staged(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    # A range's number is in the upper bits, so a source has a row for each range, and a range one for each of its slices.
    in_range = F.shiftright("slice_at", 33).alias("range")
    per_slice = staged(keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"), F.min("at").alias("slice_at")).select("source", "slice", "slice_size", in_range), "mix-slices")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_slice.groupBy(F.col("source").alias("range_source"), "range").agg(F.sum("slice_size").alias("range_size"))
    ranges = ranges.select("range_source", "range", F.coalesce(F.sum("range_size").over(earlier("range_source").orderBy("range")), F.lit(0)).alias("range_before"))
    inside_range = F.coalesce(F.sum("slice_size").over(earlier("source", "range").orderBy("slice")), F.lit(0))
    per_slice = (
        per_slice.withColumn("inside", inside_range).join(ranges, ["range"]).where(F.col("source").eqNullSafe(F.col("range_source")))
        .withColumn("before", F.col("range_before") + F.col("inside"))
    )
    t = targets.withColumnRenamed("source", "target_source")
    edges = (
        per_slice.join(t, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("whole", F.col("before") + F.col("slice_size") <= F.col("rest"))
        .withColumn("open", ~F.col("whole") & (F.col("before") < F.col("rest")))
        .select(
            F.col("source").alias("edge_source"), F.col("slice").alias("edge_slice"),
            "source_size", "target", "epochs", "rest", "before", "whole", "open",
        )
    )
    joined = keyed.join(edges, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("slice") == F.col("edge_slice")))
    inside = Window.partitionBy("source", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    settled = joined.where(~F.col("open")).withColumn("picked", F.col("whole").cast("long"))
    opened = joined.where("open").withColumn(
        "picked", (F.col("before") + F.sum("size").over(inside) - F.col("size") / 2.0 < F.col("rest")).cast("long")
    )
    # Rows of no words fit into a rest of no words too.
    copies = F.least(F.col("epochs") + F.col("picked"), F.lit(most))
    return settled.unionByName(opened).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
    )


def label_quality(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality 0/1) -> quality weights."""
    good, bad = F.lit(QUALITY["good"]), F.lit(QUALITY["bad"])
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, good).otherwise(bad).alias("quality"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs.

    A row of zero words counts as taken with the epochs and key of its place.
    Rows are matched by (doc_id, source, size).  Of rows alike in these some may be taken once more than others, where a
    target ends among them; those with the least hashes of their texts are, so the words taken are the plan's in any case.
    """
    plan = mix(docs, quality, **options).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("least"), F.max("copies").alias("copies"), F.sum("copies").alias("all"), F.count("*").alias("rows"))
    # How many of the rows alike are taken as often as the most; copies of these differ by one at most.
    plan = staged(plan.withColumn("most", F.when(F.col("least") == F.col("copies"), F.col("rows")).otherwise(F.col("all") - F.col("rows") * F.col("least"))), "mix-plan")
    # Copies of most rows are told where they lie, by filters of the plan's rows; only the others are joined with it, by a shuffle.
    name = F.xxhash64("doc_id", "source", "size")
    times = F.explode(F.array_distinct(F.array(F.col("least").cast("int"), F.col("copies").cast("int"))))
    told = key_kinds(plan.select(name.alias("name"), times.alias("times")), "name", "times")
    names = docs.columns
    by_plan = plan.where((F.col("copies") > 0) & told(name).isNull()).select(*[F.col(c).alias(f"mix plan {c}") for c in plan.columns])
    sized = docs.withColumn("mix plan words", word_count(text_or_empty()))
    sized = sized.withColumn("mix plan told", told(F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("mix plan words"))))
    found = sized.select(*[F.col(f"`{c}`") for c in names], F.col("mix plan told").cast("long").alias("mix plan times"))
    sized = staged(sized.where(F.col("mix plan told").isNull()).drop("mix plan told"), "mix-untold")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("mix plan doc_id")) & F.col("source").eqNullSafe(F.col("mix plan source")) & (F.col("mix plan words") == F.col("mix plan size"))
    even = sized.join(by_plan.where(F.col("mix plan least") == F.col("mix plan copies")), same)
    found = found.unionByName(even.select(*[F.col(f"`{c}`") for c in names], F.col("mix plan copies").alias("mix plan times")))
    split = by_plan.where(F.col("mix plan least") < F.col("mix plan copies"))
    if not split.isEmpty():
        numbered = _numbered_alike(sized.join(split, same), ["mix plan doc_id", "mix plan source", "mix plan size"])
        times = F.when(F.col("mix plan number") <= F.col("mix plan most"), F.col("mix plan copies")).otherwise(F.col("mix plan least"))
        found = found.unionByName(numbered.select(*[F.col(f"`{c}`") for c in names], times.alias("mix plan times")))
    # No filter before the rows are repeated, which would go below the filters of the plan's rows and have these asked twice.
    again = F.explode_outer(F.when(F.col("mix plan times") > 0, F.sequence(F.lit(1), F.col("mix plan times").cast("int"))))
    taken = found.select(*[F.col(f"`{c}`") for c in names], again.alias("mix plan copy")).where(F.col("mix plan copy").isNotNull())
    return taken.select(*[F.col(f"`{c}`") for c in names])


def _numbered_alike(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows + "mix plan number": place among the rows of one key, by a hash of the text; a key's rows may lie in many ranges."""
    order = [*[F.col(f"`{k}`") for k in key], F.col("mix plan hash"), F.col("mix plan tie")]
    tied = rows.withColumns({"mix plan hash": F.xxhash64(text_or_empty()), "mix plan tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(dealt.withColumns({"mix plan at": F.monotonically_increasing_id(), "mix plan range": F.spark_partition_id()}), "mix-alike")
    by = [F.col(f"`{k}`") for k in key]
    counts = placed.groupBy(*by, "mix plan range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("mix plan range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(f"`{k}`").alias(f"{k} too") for k in key], F.col("`mix plan range`").alias("range too"), "before")
    same = F.col("`mix plan range`") == F.col("range too")
    for k in key:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k} too`"))
    inside = F.row_number().over(Window.partitionBy(*by, "mix plan range").orderBy("mix plan at"))
    return placed.withColumn("mix plan inside", inside).join(counts, same).withColumn("mix plan number", F.col("before") + F.col("mix plan inside"))


def mixing_sql(salt: str = "mix") -> str:
    """DuckDB's SQL for the rows of mix() with label_quality()."""
    before = "OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
good AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, avg(CASE WHEN quality = 1 THEN {QUALITY["good"]}e0 ELSE {QUALITY["bad"]}e0 END) AS quality
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
keyed AS (SELECT sized.*, -ln((CAST('0x' || substr(md5(coalesce(CAST(sized.doc_id AS VARCHAR), '') || '{salt}'), 1, 13) AS BIGINT) + 0.5e0) / {2**52}e0)
  / coalesce(quality, {QUALITY["none"]}e0) AS key FROM sized LEFT JOIN good ON good.doc_id = sized.doc_id),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * {MOST_EPOCHS}e0 AS cap FROM sources),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) {before}, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) {before}, 0e0)) AS level FROM weighed),
free AS (SELECT *, max(CASE WHEN level * weight < cap THEN level END) OVER () AS free_level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN free_level IS NULL THEN cap ELSE least(cap, free_level * weight) END AS target FROM free),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0e0 END AS epochs FROM targets),
placed AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2e0 AS middle
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN middle < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""
