"""B1–B3, B8–B11 — route parsed records to tables/columns and type them.

Routing is a lookup in a literal map built from the manifest on the driver
(its size is the manifest's, independent of the data), so it compiles into
the projection — no join, no shuffle, inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kardia.functions.dates import normalize_date, parse_export_date
from kardia.functions.scalars import content_id, sleep_stage_code, typed_cast
from kardia.manifest import BASE_TIME_COLUMNS, SUBJECT, Manifest, Table, spark_type


# FIXED VALUE: the sleep-stage record type, whose values may be symbolic names.
SLEEP_ANALYSIS = "HKCategoryTypeIdentifierSleepAnalysis"


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def metric_lookup(manifest: Manifest) -> Column:
    """map<hk_identifier, struct(table_name, column_name, data_type)> literal.

    Built as one SQL expression (one JVM call) rather than hundreds of
    ``lit`` calls; Catalyst folds it to a constant map."""
    entries = []
    for hk, table, column, dtype in manifest.metric_map():
        entries.append(f"{_sql_str(hk)}, named_struct('table_name', {_sql_str(table)}, "
                       f"'column_name', {_sql_str(column)}, 'data_type', {_sql_str(dtype)})")
    if not entries:
        raise ValueError("manifest routes no record type")
    return F.expr(f"map({', '.join(entries)})")


def route_records(records: DataFrame, manifest: Manifest, type_col: str = "type") -> DataFrame:
    """B1: keep records whose type is routed; add table_name/column_name/data_type.

    Unmapped types are dropped (and not counted)."""
    m = metric_lookup(manifest)
    route = F.try_element_at(m, F.col(type_col))
    return (records.select("*", route.alias("_route")).filter(F.col("_route").isNotNull())
            .select(*[F.col(c) for c in records.columns],
                    F.col("_route.table_name").alias("table_name"),
                    F.col("_route.column_name").alias("column_name"),
                    F.col("_route.data_type").alias("data_type")))


def with_normalised_dates(records: DataFrame) -> DataFrame:
    """B8 + typed dates: ``*_text`` (normalised, raw passthrough) and TIMESTAMPs."""
    cols = []
    for base in BASE_TIME_COLUMNS:
        raw = F.col(f"{base}_raw")
        cols += [normalize_date(raw).alias(f"{base}_text"), parse_export_date(raw).alias(base)]
    return records.select("*", *cols)


def with_content_id(records: DataFrame, id_col: str = "uuid") -> DataFrame:
    """Hex SHA-256 of table‖column‖start‖end‖value (normalised dates, raw value)."""
    return records.withColumn(id_col, content_id(
        F.col("table_name"), F.col("column_name"), F.col("start_date_text"),
        F.col("end_date_text"), F.col("value")))


def wide_projection(routed: DataFrame, table: Table, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """B3 + B10: rows of one table, value in its typed column, other metrics NULL."""
    cols = [F.col(SUBJECT) if SUBJECT in routed.columns else F.lit(None).cast("string").alias(SUBJECT),
            F.col("uuid")]
    cols += [F.col(c) for c in BASE_TIME_COLUMNS]
    for c in table.stored_columns:
        value = typed_cast(F.col("value"), c.data_type)
        if c.hk_identifier == SLEEP_ANALYSIS and c.data_type == "INTEGER":
            value = sleep_stage_code(F.trim(F.col("value")))  # D5: symbolic stage names
        cols.append(F.when(F.col("column_name") == c.field_name, value)
                    .otherwise(F.lit(None).cast(spark_type(c.data_type))).alias(c.field_name))
    cols += [F.col(c) for c in extra_cols]
    return routed.filter(F.col("table_name") == table.name).select(*cols)


def with_generated_columns(df: DataFrame, table: Table) -> DataFrame:
    """Manifest ``expression`` columns, computed at read in declaration order."""
    out = df
    for c in table.generated_columns:
        out = out.withColumn(c.field_name, F.expr(c.expression).cast(spark_type(c.data_type)))
    return out


def conform(df: DataFrame, schema) -> DataFrame:
    """Project onto a target schema; columns missing from ``df`` become NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
