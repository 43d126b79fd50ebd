"""Declarative manifest: which export element feeds which typed column.

The manifest is parsed on the driver with the standard-library TOML reader
into frozen dataclasses; everything downstream (routing map, Spark schemas,
aggregate lists, allow-lists) is generated from it. Loading validates the
things that would otherwise fail late or silently on the cluster:

* identifiers (table / column names) must be plain SQL identifiers, because
  they become column names and are used in generated expressions;
* ``aggregate`` must be one of raw/avg/sum/min/max/count;
* a HealthKit identifier may be routed (``extraction_source`` absent or
  ``"value"``) to one column only — otherwise "an arbitrary one wins";
* ECG header keys may not start with a digit or ``-`` (those lines open the
  sample section).
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

from pyspark.sql import types as T

IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
AGGREGATES = ("raw", "avg", "sum", "min", "max", "count")
EXTRACTION_SOURCES = (None, "value", "attribute", "statistics_sum", "metadata_value", "route_ref")

# Base columns present on every metric table (after the key).
BASE_TIME_COLUMNS = ("creation_date", "start_date", "end_date")
SUBJECT = "subject_id"


class ManifestError(ValueError):
    """Raised for a manifest that cannot be used."""


@dataclass(frozen=True)
class Column:
    field_name: str
    data_type: str = "TEXT"
    hk_identifier: str | None = None
    hk_attribute: str | None = None
    is_primary_key: bool = False
    extraction_source: str | None = None
    aggregate: str = "raw"
    expression: str | None = None

    @property
    def routed(self) -> bool:
        """True if plain ``<Record type=...>`` values feed this column."""
        return self.hk_identifier is not None and self.extraction_source in (None, "value")

    @property
    def numeric(self) -> bool:
        return self.data_type.upper() in ("REAL", "INTEGER")


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    description: str | None = None

    @property
    def key(self) -> str:
        """Declared primary-key column (first one), else the content id ``uuid``."""
        for c in self.columns:
            if c.is_primary_key:
                return c.field_name
        return "uuid"

    @property
    def stored_columns(self) -> tuple[Column, ...]:
        """Columns persisted (generated ``expression`` columns are computed at read)."""
        return tuple(c for c in self.columns if c.expression is None and c.field_name != self.key)

    @property
    def generated_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.expression is not None)

    def column(self, name: str) -> Column | None:
        for c in self.columns:
            if c.field_name == name:
                return c
        return None


@dataclass(frozen=True)
class EcgSource:
    folder: str
    target_table: str
    metadata_map: tuple[tuple[str, str, str], ...]  # (csv_key, db_column, data_type)
    payload_column: str = "voltage_samples"
    file_extension: str = "csv"


@dataclass(frozen=True)
class RouteSource:
    folder: str
    target_table: str
    columns: tuple[tuple[str, str, str], ...]  # (xml_tag, db_column, data_type)
    file_extension: str = "gpx"


@dataclass(frozen=True)
class Manifest:
    tables: dict[str, Table]
    ecg: EcgSource | None = None
    routes: RouteSource | None = None
    batch_size: int = 5000
    max_heart_rate: float = 190.0
    resting_heart_rate: float = 60.0
    timezone: str = "UTC"
    import_dirs: tuple[str, ...] = field(default_factory=tuple)

    # ---- derived views -------------------------------------------------
    def metric_map(self) -> list[tuple[str, str, str, str]]:
        """(hk_identifier, table, column, data_type) for every routed column."""
        out = []
        for t in self.tables.values():
            for c in t.columns:
                if c.routed:
                    out.append((c.hk_identifier, t.name, c.field_name, c.data_type.upper()))
        return out

    def external_tables(self) -> list[str]:
        return [s.target_table for s in (self.ecg, self.routes) if s is not None]

    def check_table(self, name: str, allow_external: bool = False) -> str:
        """Allow-list check for a table name coming from a caller."""
        if name in self.tables:
            return name
        if allow_external and name in self.external_tables():
            return name
        raise ManifestError(f"table {name!r} is not in the manifest")

    def table(self, name: str) -> Table:
        return self.tables[self.check_table(name)]


# ---- parsing --------------------------------------------------------------

def _ident(name: object, what: str) -> str:
    if not isinstance(name, str) or not IDENT.match(name):
        raise ManifestError(f"bad {what} identifier: {name!r}")
    return name


def _column(raw: dict, table: str) -> Column:
    name = raw.get("field_name", raw.get("name"))
    _ident(name, f"column in {table}")
    agg = str(raw.get("aggregate", "raw")).lower()
    if agg not in AGGREGATES:
        raise ManifestError(f"{table}.{name}: unknown aggregate {agg!r}")
    src = raw.get("extraction_source")
    if src not in EXTRACTION_SOURCES:
        raise ManifestError(f"{table}.{name}: unknown extraction_source {src!r}")
    return Column(
        field_name=name,
        data_type=str(raw.get("data_type", "TEXT")).upper(),
        hk_identifier=raw.get("hk_identifier", raw.get("hk_type")),
        hk_attribute=raw.get("hk_attribute"),
        is_primary_key=bool(raw.get("is_primary_key", False)),
        extraction_source=src,
        aggregate=agg,
        expression=raw.get("expression"),
    )


def parse_manifest(doc: dict) -> Manifest:
    tables: dict[str, Table] = {}
    for tname, tcfg in (doc.get("tables") or {}).items():
        _ident(tname, "table")
        cols = tuple(_column(c, tname) for c in tcfg.get("columns", []))
        names = [c.field_name for c in cols]
        if len(set(names)) != len(names):
            raise ManifestError(f"{tname}: duplicate column names")
        tables[tname] = Table(tname, cols, tcfg.get("description"))

    seen: dict[str, str] = {}
    for t in tables.values():
        for c in t.columns:
            if c.routed:
                where = f"{t.name}.{c.field_name}"
                if c.hk_identifier in seen:
                    raise ManifestError(
                        f"{c.hk_identifier} routed to both {seen[c.hk_identifier]} and {where}")
                seen[c.hk_identifier] = where

    ext = doc.get("external_sources") or {}
    ecg = None
    if "ecg" in ext:
        e = ext["ecg"]
        mm = []
        for m in e.get("metadata_map", []):
            key = m["csv_key"]
            if not key or key[0].isdigit() or key[0] == "-":
                raise ManifestError(f"ECG header key {key!r} would start the sample section")
            mm.append((key, _ident(m["db_column"], "ECG column"), str(m.get("data_type", "TEXT")).upper()))
        payload = (e.get("payload") or {}).get("db_column", "voltage_samples")
        ecg = EcgSource(e.get("folder", "electrocardiograms"),
                        _ident(e.get("target_table", "ecg_recordings"), "table"),
                        tuple(mm), _ident(payload, "ECG payload column"))
    routes = None
    if "routes" in ext:
        r = ext["routes"]
        cols = tuple((c["xml_tag"], _ident(c["db_column"], "route column"),
                      str(c.get("data_type", "TEXT")).upper()) for c in r.get("columns", []))
        routes = RouteSource(r.get("folder", "workout-routes"),
                             _ident(r.get("target_table", "route_points"), "table"), cols)

    settings = doc.get("settings") or {}
    profile = doc.get("user_profile") or {}
    return Manifest(
        tables=tables, ecg=ecg, routes=routes,
        batch_size=int(settings.get("batch_size", 5000)),
        max_heart_rate=float(profile.get("max_heart_rate", 190)),
        resting_heart_rate=float(profile.get("resting_heart_rate", 60)),
        timezone=settings.get("timezone", "UTC"),
        import_dirs=tuple(settings.get("import_dirs", ())),
    )


def load_manifest(source: str | Path) -> Manifest:
    """Load from a path, or from TOML text when ``source`` holds a newline."""
    if isinstance(source, str) and "\n" in source:
        return parse_manifest(tomllib.loads(source))
    with open(source, "rb") as fh:
        return parse_manifest(tomllib.load(fh))


def default_manifest() -> Manifest:
    text = resources.files("kardia").joinpath("manifests/health.toml").read_text()
    return parse_manifest(tomllib.loads(text))


# ---- Spark schemas --------------------------------------------------------

def spark_type(data_type: str) -> T.DataType:
    """Spark type for a manifest type (values are cast once, with try_cast)."""
    dt = data_type.upper()
    if dt == "REAL":
        return T.DoubleType()
    if dt == "INTEGER":
        return T.LongType()
    if dt == "DATETIME":
        return T.TimestampType()
    return T.StringType()


def table_schema(table: Table) -> T.StructType:
    """Stored schema of a metric table: subject, key, base dates, metric columns.

    A DATETIME primary key (workouts' ``session_id``) stays the raw text, as
    it is an identifier rather than a time.
    """
    fields = [T.StructField(SUBJECT, T.StringType()), T.StructField(table.key, T.StringType())]
    fields += [T.StructField(c, T.TimestampType()) for c in BASE_TIME_COLUMNS]
    for c in table.stored_columns:
        fields.append(T.StructField(c.field_name, spark_type(c.data_type)))
    return T.StructType(fields)


def ecg_schema(src: EcgSource) -> T.StructType:
    fields = [T.StructField(SUBJECT, T.StringType()), T.StructField("file_name", T.StringType()),
              T.StructField("sample_count", T.LongType()), T.StructField("mean_voltage", T.DoubleType()),
              T.StructField("calculated_hr", T.DoubleType())]
    for _, col, dt in src.metadata_map:
        fields.append(T.StructField(col, T.TimestampType() if dt == "DATETIME" else T.StringType()))
        if dt == "DATETIME":
            fields.append(T.StructField(f"{col}_raw", T.StringType()))
    fields.append(T.StructField(src.payload_column, T.StringType()))
    return T.StructType(fields)


def route_schema(src: RouteSource) -> T.StructType:
    fields = [T.StructField(SUBJECT, T.StringType()), T.StructField("file_name", T.StringType())]
    for _, col, dt in src.columns:
        fields.append(T.StructField(col, spark_type(dt)))
        if dt == "DATETIME":
            fields.append(T.StructField(f"{col}_raw", T.StringType()))
    return T.StructType(fields)
