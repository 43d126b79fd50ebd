"""A2, A3, A5, B4–B7, B18 — element-level XML sources.

``<Workout>`` and ``<ActivitySummary>`` elements come from the tag scan (:mod:`kardia.sources.tags`) as
text and are parsed by ``from_xml`` under an explicit schema generated from
the manifest; GPX ``<trkpt>`` elements are read with Spark's XML source (``rowTag``). All
extraction is column expressions on the parsed struct:

* attributes -> columns (one attribute may feed several columns);
* ``statistics_sum`` / ``metadata_value``: the *last* matching child wins —
  ``element_at(filter(children, x -> x.key = id), -1)``; route-level
  ``MetadataEntry`` elements count too (the element walk is flat);
* ``route_ref``: base name of the last ``FileReference/@path``.

Self-closing workouts and non-self-closing summaries are both accepted (D7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kardia.functions.dates import parse_any_date, parse_export_date
from kardia.functions.scalars import base_name, typed_cast
from kardia.manifest import SUBJECT, Manifest, RouteSource, Table
from kardia.sources import tags

# FIXED VALUES: element / attribute names of the formats.
TRKPT_TAG = "trkpt"
DATE_ATTRIBUTES = ("creationDate", "startDate", "endDate")
SUMMARY_DATE_ATTRIBUTE = "dateComponents"


def _attr_fields(attrs) -> list[str]:
    return [f"_{a} string" for a in attrs]


def workout_schema(table: Table) -> str:
    attrs = list(dict.fromkeys([c.hk_attribute for c in table.columns
                                if c.extraction_source == "attribute" and c.hk_attribute] + list(DATE_ATTRIBUTES)))
    kv = "array<struct<_key: string, _value: string>>"
    return ", ".join(_attr_fields(attrs) + [
        "WorkoutStatistics array<struct<_type: string, _sum: string>>",
        f"MetadataEntry {kv}",
        f"WorkoutRoute array<struct<MetadataEntry: {kv}, FileReference: array<struct<_path: string>>>>",
    ])


def summary_schema(table: Table) -> str:
    attrs = list(dict.fromkeys([c.hk_attribute for c in table.columns if c.hk_attribute]))
    return ", ".join(_attr_fields(attrs))


def gpx_schema(src: RouteSource) -> str:
    """Point attributes ``lat``/``lon``, child element text by tag name, and the
    ``extensions`` block as text: a tag may sit in it at any depth."""
    fields = ["_lat string", "_lon string"]
    tags = [t for t, _, _ in src.columns if t not in ("lat", "lon")]
    fields += [f"`{t}` string" for t in tags]
    return ", ".join([*fields, "extensions string"])


def _nested(block: Column, tag: str) -> Column:
    """Text of the first element of this name in a block of XML text, with or without a prefix; NULL if there is none."""
    found = F.regexp_extract(block, rf"<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>([^<]*)</", 1)
    return F.when(found != "", found)


def parse_elements(df: DataFrame, xml: Column, schema: str, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Element text -> one column per schema field, parsed once per row.

    The parse sits under a one-row ``inline`` generator: field accesses on a
    plain ``from_xml`` struct count as cheap extractions, so Catalyst would
    otherwise inline the whole parse into every one of them."""
    return df.select(*keep, F.inline(F.array(F.from_xml(xml, schema))))


def _last(arr: Column, key_field: str, key: str, value_field: str) -> Column:
    return F.try_element_at(F.filter(arr, lambda x: x[key_field] == F.lit(key)), F.lit(-1))[value_field]


def _cast(c: Column, data_type: str) -> Column:
    return typed_cast(c, data_type)


def extract_workouts(parsed: DataFrame, table: Table, struct_col: str | None = None,
                     keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Parsed ``<Workout>`` rows -> stored workout rows (manifest columns)."""
    def a(name):
        return F.col(f"{struct_col}.{name}") if struct_col else F.col(name)

    stats = F.coalesce(a("WorkoutStatistics"), F.array().cast("array<struct<_type:string,_sum:string>>"))
    routes = F.coalesce(a("WorkoutRoute"), F.array().cast(
        "array<struct<MetadataEntry:array<struct<_key:string,_value:string>>,FileReference:array<struct<_path:string>>>>"))
    kv_type = "array<struct<_key:string,_value:string>>"
    meta = F.concat(F.coalesce(a("MetadataEntry"), F.array().cast(kv_type)),
                    F.flatten(F.transform(routes, lambda r: F.coalesce(r["MetadataEntry"], F.array().cast(kv_type)))))
    refs = F.flatten(F.transform(routes, lambda r: F.coalesce(r["FileReference"], F.array().cast("array<struct<_path:string>>"))))
    refs = F.filter(refs, lambda x: x["_path"].isNotNull())
    # the lists are made once a row, whatever number of columns looks into them
    parsed = parsed.select("*", stats.alias("__stats"), meta.alias("__meta"), refs.alias("__refs"))
    stats, meta, refs = F.col("__stats"), F.col("__meta"), F.col("__refs")
    cols = [*[F.col(k) for k in keep]]
    for c in table.columns:
        if c.field_name == table.key:
            raw = a(f"_{c.hk_attribute}")
            cols.append(raw.alias(c.field_name))           # K7: the raw start text
            continue
        src = c.extraction_source
        if src == "attribute":
            v = _cast(a(f"_{c.hk_attribute}"), c.data_type)
        elif src == "statistics_sum":
            v = _cast(_last(stats, "_type", c.hk_identifier, "_sum"), c.data_type)
        elif src == "metadata_value":
            v = _cast(_last(meta, "_key", c.hk_identifier, "_value"), c.data_type)
        elif src == "route_ref":
            v = base_name(F.try_element_at(refs, F.lit(-1))["_path"])
        else:
            continue
        cols.append(v.alias(c.field_name))
    cols += [parse_export_date(a("_creationDate")).alias("creation_date"),
             parse_export_date(a("_startDate")).alias("start_date"),
             parse_export_date(a("_endDate")).alias("end_date")]
    return parsed.select(*cols)


def extract_summaries(parsed: DataFrame, table: Table, struct_col: str | None = None,
                      keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Parsed ``<ActivitySummary>`` rows -> stored rows; D16: ``start_date`` is
    midnight of the summary date when it parses; D11: rows with no mapped
    attribute are dropped."""
    def a(name):
        return F.col(f"{struct_col}.{name}") if struct_col else F.col(name)

    cols = [F.col(k) for k in keep]
    any_attr = F.lit(False)
    for c in table.columns:
        raw = a(f"_{c.hk_attribute}")
        any_attr = any_attr | raw.isNotNull()
        v = raw if c.field_name == table.key else _cast(raw, c.data_type)
        cols.append(v.alias(c.field_name))
    date_col = next((c.field_name for c in table.columns if c.hk_attribute == SUMMARY_DATE_ATTRIBUTE), None)
    start = F.to_timestamp(F.try_to_date(F.col(date_col), "yyyy-MM-dd")) if date_col else F.lit(None)
    out = parsed.filter(any_attr).select(*cols)
    return out.select("*", F.lit(None).cast("timestamp").alias("creation_date"),
                      start.cast("timestamp").alias("start_date"), F.lit(None).cast("timestamp").alias("end_date"))


def extract_route_points(parsed: DataFrame, src: RouteSource, struct_col: str | None = None,
                         keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Parsed ``<trkpt>`` rows -> route point rows; a missing tag is NULL."""
    def a(name):
        return F.col(f"{struct_col}.{name}") if struct_col else F.col(name)

    cols = [F.col(k) for k in keep]
    for tag, col, dtype in src.columns:
        if tag in ("lat", "lon"):
            raw = a(f"_{tag}")
        else:
            raw = F.coalesce(a(f"`{tag}`"), _nested(a("extensions"), tag))
        if dtype == "DATETIME":
            cols += [parse_any_date(raw).alias(col), raw.alias(f"{col}_raw")]
        else:
            cols.append(_cast(raw, dtype).alias(col))
    return parsed.select(*cols)


# ---- elements regrouped from the tag scan ---------------------------------------

def workouts_from_texts(texts: DataFrame, t: Table, keep: list[str] | tuple[str, ...] = (SUBJECT,)) -> DataFrame:
    return extract_workouts(parse_elements(texts, F.col("xml"), workout_schema(t), keep), t, keep=keep)


def summaries_from_texts(texts: DataFrame, t: Table, keep: list[str] | tuple[str, ...] = (SUBJECT,)) -> DataFrame:
    return extract_summaries(parse_elements(texts, F.col("xml"), summary_schema(t), keep), t, keep=keep)


# tag -> table, is a tag row one of its (given the table), texts from tag rows, rows from texts, order of the first one kept
ELEMENTS = {
    tags.WORKOUT_TAG: ("workouts", tags.workout_tags, tags.workout_texts, workouts_from_texts, ["creation_date"]),
    tags.SUMMARY_TAG: ("activity_summaries", lambda t: F.col("name") == tags.SUMMARY_TAG, tags.summary_texts, summaries_from_texts, None),
}


def scan_elements(spark: SparkSession, paths: str | list[str], manifest: Manifest, tag: str, stage: str | None = None) -> DataFrame:
    """A2, A3: rows of one element kind of export files, with their ``file_path``; cut-off elements are left out.

    Where an element has tags to regroup, they are kept in ``stage`` (a scratch folder by default), which the rows are read from."""
    name, is_part, texts_of, rows_of, _ = ELEMENTS[tag]
    table = manifest.tables[name]
    texts = texts_of(tags.placed(tags.read_tags(spark, paths)).filter(is_part(table)), stage).filter(F.col("xml").isNotNull())
    return rows_of(texts, table, keep=("file_path",))


# ---- file scans (XML source: one task per file; for small files) ------------

def _read(spark: SparkSession, paths, row_tag: str, schema: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(paths)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_name").alias("file_name"))


def scan_gpx(spark: SparkSession, folder: str | list[str], src: RouteSource, keep: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """A5: every ``<trkpt>`` of the ``*.gpx`` files in a folder (or of a list of files), with the file's name or path."""
    return extract_route_points(_read(spark, folder, TRKPT_TAG, gpx_schema(src), glob=f"*.{src.file_extension}"), src, keep=keep)
