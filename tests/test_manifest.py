import pytest

from kardia.manifest import ManifestError, default_manifest, load_manifest, table_schema


def test_default_manifest_shape():
    m = default_manifest()
    assert list(m.tables)[:3] == ["workouts", "body_metrics", "vitals"]
    assert m.tables["workouts"].key == "session_id"
    assert m.tables["activity_summaries"].key == "date"
    assert m.tables["vitals"].key == "uuid"
    assert m.max_heart_rate == 190.0 and m.batch_size == 5000
    assert m.ecg.target_table == "ecg_recordings" and m.routes.target_table == "route_points"
    routed = {hk for hk, *_ in m.metric_map()}
    # workout statistics are not routed from <Record> even if the type is shared
    assert "HKQuantityTypeIdentifierActiveEnergyBurned" in routed
    assert ("HKQuantityTypeIdentifierActiveEnergyBurned", "activity", "active_cals", "REAL") in m.metric_map()
    names = [f.name for f in table_schema(m.tables["vitals"]).fields]
    assert names[:5] == ["subject_id", "uuid", "creation_date", "start_date", "end_date"]


def test_aliases_and_generated_columns():
    m = load_manifest("""
[tables.records]
columns = [
  { name = "heart_rate", hk_type = "HKQuantityTypeIdentifierHeartRate", aggregate = "avg", data_type = "REAL" },
  { name = "effort", data_type = "REAL", expression = "heart_rate * 0.1" },
]
""")
    t = m.tables["records"]
    assert t.columns[0].hk_identifier == "HKQuantityTypeIdentifierHeartRate"
    assert [c.field_name for c in t.stored_columns] == ["heart_rate"]
    assert [c.field_name for c in t.generated_columns] == ["effort"]


@pytest.mark.parametrize("bad", [
    '[tables.t]\ncolumns = [{ name = "x", aggregate = "median" }]\n',
    '[tables.t]\ncolumns = [{ name = "x y" }]\n',
    '[tables."t;drop"]\ncolumns = [{ name = "x" }]\n',
    '[tables.a]\ncolumns = [{ name = "x", hk_type = "H" }]\n[tables.b]\ncolumns = [{ name = "y", hk_type = "H" }]\n',
    '[external_sources.ecg]\ntarget_table = "e"\nmetadata_map = [{ csv_key = "1st", db_column = "c" }]\n',
])
def test_rejected(bad):
    with pytest.raises(ManifestError):
        load_manifest(bad)


def test_allow_list():
    m = default_manifest()
    assert m.check_table("vitals") == "vitals"
    assert m.check_table("route_points", allow_external=True) == "route_points"
    with pytest.raises(ManifestError):
        m.check_table("route_points")
    with pytest.raises(ManifestError):
        m.check_table("sqlite_master")
