"""A1 — the ``<Record>`` elements of large export XML files.

The rows come from :mod:`kardia.sources.tags`: one tag each, read by as many tasks as a file has splits. (The XML
source reads a whole file in one task, and line mode breaks records that span lines.) A record is its start
tag; children such as ``MetadataEntry`` are tags of their own and don't count, as in the reference. The attributes are parsed by
``from_xml``, which also decodes entities.

A record whose start tag cannot be isolated or parsed is returned by :func:`split_quarantine` instead of
being lost (A8/A9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kardia.sources import tags

# FIXED VALUES: attribute names of an exported <Record> element.
RECORD_ATTRIBUTES = ("type", "sourceName", "sourceVersion", "unit", "device",
                     "creationDate", "startDate", "endDate", "value")
_SNAKE = {"type": "type", "sourceName": "source_name", "sourceVersion": "source_version",
          "unit": "unit", "device": "device", "creationDate": "creation_date_raw",
          "startDate": "start_date_raw", "endDate": "end_date_raw", "value": "value"}
RECORD_XML_SCHEMA = ", ".join(f"_{a} string" for a in RECORD_ATTRIBUTES)


def record_chunks(rows: DataFrame) -> DataFrame:
    """The records of tag rows: ``chunk``, the text behind ``<Record``, and the other columns."""
    found = tags.named(rows).filter(F.col("name") == tags.RECORD_TAG)
    return found.select(tags.record_chunk(F.col("tag")).alias("chunk"), *[c for c in rows.columns if c != "tag"])


def read_record_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One chunk per record (folders recursively), plus the file path."""
    return record_chunks(tags.read_tags(spark, paths)).select("chunk", "file_path")


def is_record_chunk(chunk: Column) -> Column:
    """A record has an attribute: white space and a name follow the tag's name."""
    return chunk.rlike(r"^\s+[A-Za-z_:]")


def parse_record_chunks(chunks: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """Chunks -> one row per record: attributes as text columns.

    Output columns: every passthrough column of ``chunks`` except the chunk,
    then ``type, source_name, source_version, unit, device, creation_date_raw,
    start_date_raw, end_date_raw, value, parse_ok, raw`` (``raw``: the start tag, or
    the whole chunk if no tag can be isolated; for quarantine).
    """
    return _parsed(chunks.filter(is_record_chunk(F.col(chunk_col))), chunk_col, F.lit(True))


def parse_tags(rows: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """As :func:`parse_record_chunks`, but rows that aren't records pass by with NULL attributes and ``parse_ok``
    NULL, so that one scan of a file serves records and elements."""
    return _parsed(rows, chunk_col, (F.col("name") == tags.RECORD_TAG) & is_record_chunk(F.col(chunk_col)))


def _parsed(rows: DataFrame, chunk_col: str, is_record: Column) -> DataFrame:
    keep = [c for c in rows.columns if c != chunk_col]
    # Each expensive step (tag regex, XML parse) sits under a one-row
    # ``inline`` generator: a later filter on its output (parse_ok, type) then
    # cannot be pushed below it, which would evaluate the step twice per row.
    tagged = rows.select(*keep, F.col(chunk_col).alias("_chunk"),
                         F.inline(F.array(F.struct(F.when(is_record, tags.start_tag(F.col(chunk_col))).alias("_tag")))))
    xml = F.from_xml(F.concat(F.lit(f"<{tags.RECORD_TAG} "), F.col("_tag"), F.lit("/>")), RECORD_XML_SCHEMA)
    parsed = tagged.select(*keep, "_chunk", "_tag", F.inline(F.array(xml)))
    attrs = [F.col(f"_{a}").alias(_SNAKE[a]) for a in RECORD_ATTRIBUTES]
    ok = F.when(F.col("_tag").isNotNull(), (F.col("_tag") != "") & F.col("_type").isNotNull())
    return parsed.select(*keep, *attrs, ok.alias("parse_ok"), F.when(F.col("_tag") == "", F.col("_chunk")).otherwise(F.col("_tag")).alias("raw"))


def split_quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) — a bad record never stops the rest."""
    good = records.filter(F.col("parse_ok")).drop("parse_ok", "raw")
    bad = records.filter(~F.col("parse_ok")).drop("parse_ok")
    return good, bad


def scan_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole A1 scan: text split -> start tag -> attributes (incl. parse_ok)."""
    return parse_record_chunks(read_record_chunks(spark, paths))
