"""A1–A3, I1 — one tag per row: the splittable scan under records, workouts and daily summaries.

An export is read as text split at ``<``. In well-formed XML that character only begins a tag, so a row is one tag
with the text behind it, whatever the file holds and in whatever order: no row spans more than one element, no
part of a file is one task's, and no cap is needed. Hadoop splits the file at any byte; a row belongs to the split
in which it begins. Batch and stream read the same rows, so they find the same elements.

A record or a daily summary is its start tag. A workout is regrouped from its start tag, the mapped
children and its end tag by their place in the file: inside a split the last start or end before a row is a running
value over the split's rows; a split hands its last one to the splits behind it by a small table of one row per
split. A split's rows are bounded by the split's size, so no file is one task's here either.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamReader

from kardia.manifest import Table
from kardia.session import scratch_dir

# FIXED VALUES: element names of the export format.
RECORD_TAG = "Record"
WORKOUT_TAG = "Workout"
SUMMARY_TAG = "ActivitySummary"
STATISTICS_TAG = "WorkoutStatistics"
METADATA_TAG = "MetadataEntry"
ROUTE_TAG = "WorkoutRoute"
FILE_TAG = "FileReference"

SEPARATOR = "<"
# attribute text up to the first '>' outside quotes
START_TAG = r"""^([^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+)>"""


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("value").alias("tag"), F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("block"))


def _options(reader):
    return reader.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true")


def read_tags(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(tag, file_path, block)`` of every file (folders recursively): the text behind each ``<``."""
    return _columns(_options(spark.read).text(paths))


def tag_stream(spark: SparkSession, folder: str, max_files_per_trigger: int) -> DataFrame:
    """The same rows of the files that appear below ``folder``; a file is in one micro-batch as a whole."""
    reader: DataStreamReader = _options(spark.readStream.format("text"))
    return _columns(reader.option("maxFilesPerTrigger", max_files_per_trigger).load(folder))


def named(tags: DataFrame) -> DataFrame:
    """Add ``name``, the tag's name with ``/`` in front of an end tag."""
    return tags.withColumn("name", F.regexp_extract("tag", r"^(/?[A-Za-z_:][\w:.-]*)(?=[\s/>]|$)", 1))


def placed(tags: DataFrame) -> DataFrame:
    """Add ``name`` and ``place``, ascending in each split of a file (not for streams; a micro-batch is none)."""
    return named(tags.withColumn("place", F.monotonically_increasing_id()))


def record_chunk(tag):
    """The text behind ``<Record``."""
    return F.substring(tag, F.lit(len(RECORD_TAG) + 1), F.length(tag))


def without_slash(head):
    return F.regexp_replace(head, r"\s*/\s*$", "")


def start_tag(text):
    """The text of a start tag up to its end, '' if it has none; a trailing '/' is removed."""
    return without_slash(F.regexp_extract(text, START_TAG, 1))


def workout_tags(workouts: Table):
    """Is a row (``tag``, ``name``) a workout's start or end, or a child that the manifest maps?

    Entries of other keys, as records have them, too, can't change a workout and are left out."""
    wanted = [c.hk_identifier for c in workouts.columns if c.extraction_source in ("statistics_sum", "metadata_value") and c.hk_identifier]
    child = F.col("name") == FILE_TAG
    if wanted:
        mapped = reduce(or_, [F.contains("tag", F.lit(w)) for w in wanted])
        child = child | (F.col("name").isin(STATISTICS_TAG, METADATA_TAG) & mapped)
    return F.col("name").isin(WORKOUT_TAG, f"/{WORKOUT_TAG}") | child


def summary_texts(tags: DataFrame, stage: str | None = None) -> DataFrame:
    """``(file_path, xml, raw)`` of daily summaries; ``xml`` is NULL if the start tag is cut off."""
    head = start_tag(F.col("tag"))
    return tags.select("file_path", F.when(head != "", F.concat(F.lit("<"), head, F.lit("/>"))).alias("xml"), F.concat(F.lit("<"), "tag").alias("raw"))


def workout_texts(tags: DataFrame, stage: str | None = None) -> DataFrame:
    """``(file_path, xml, raw)`` of workouts, from ``tags(tag, file_path, block, place, name)``.

    ``xml`` holds the start tag and the mapped children in the file's order; it is NULL for a workout that has no end
    (or whose tags are cut off), of which ``raw`` is what was found. One row for each start tag.

    The tags are read and matched once and written to ``stage`` (a scratch folder by default): the regrouping and the marks
    that splits hand on are two readers of them."""
    # the tag's text is matched once: what follows reads it from a column
    heads = tags.select("file_path", "block", "place", "name", "tag", F.regexp_extract("tag", START_TAG, 1).alias("head"))
    heads = heads.withColumn("text", without_slash(F.col("head")))
    rows = heads.select("file_path", "block", "place", "name", (F.col("text") != "").alias("whole"), F.when(F.col("text") != "", F.col("text")).otherwise(F.col("tag")).alias("text"),
                        ((F.col("name") == WORKOUT_TAG) & F.col("head").rlike(r"/\s*$")).alias("closed"))
    # what a row leaves open for those behind it: a workout's place, -1 for none, NULL for no change
    mark = (F.when(F.col("name") == f"/{WORKOUT_TAG}", F.lit(-1).cast("long"))
            .when(F.col("name") == WORKOUT_TAG, F.when(F.col("closed"), F.lit(-1).cast("long")).otherwise(F.col("place"))))
    spark, stage = tags.sparkSession, stage or scratch_dir(tags.sparkSession, "workout-tags")
    marked = rows.withColumn("mark", mark)
    marked.write.mode("overwrite").parquet(stage)
    rows = spark.read.schema(marked.schema).parquet(stage)
    split = Window.partitionBy("file_path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("before", F.last("mark", ignorenulls=True).over(split))
    splits = rows.groupBy("file_path", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("place"))).alias("left"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file_path", "block", F.last("left", ignorenulls=True).over(earlier).alias("carried"))
    before = F.coalesce("before", "carried")
    owner = F.when(F.col("name") == WORKOUT_TAG, F.col("place")).when(before >= 0, before)
    owned = within.join(carried, ["file_path", "block"]).withColumn("workout", owner).where("workout IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "name", "whole", "text")))
    groups = owned.groupBy("workout", "file_path").agg(parts.alias("parts"), F.max("closed").alias("closed"))
    complete = F.forall("parts", lambda p: p["whole"]) & (F.col("closed") | F.exists("parts", lambda p: p["name"] == f"/{WORKOUT_TAG}"))
    children = F.transform(F.filter("parts", lambda p: ~p["name"].isin(WORKOUT_TAG, f"/{WORKOUT_TAG}")), lambda p: F.when(
        p["name"] == FILE_TAG, F.concat(F.lit(f"<{ROUTE_TAG}><"), p["text"], F.lit(f"/></{ROUTE_TAG}>"))).otherwise(F.concat(F.lit("<"), p["text"], F.lit("/>"))))
    xml = F.concat(F.lit("<"), F.col("parts")[0]["text"], F.lit(">"), F.array_join(children, ""), F.lit(f"</{WORKOUT_TAG}>"))
    raw = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("<"), p["text"], F.when(p["whole"], F.lit(">")).otherwise(F.lit("")))), "\n")
    return groups.select("file_path", F.when(complete, xml).alias("xml"), raw.alias("raw"))
