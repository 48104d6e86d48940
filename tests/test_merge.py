import datetime as dt

import pytest

from loamwork.merge.config import MergeConfig, MergeDefaults, ValidationError, configuration_checks, resolve, upsert, validate
from loamwork.merge.router import execute
from loamwork.sources.tables import VersionedTable
from loamwork.streaming.merge_sink import merge_stream

D, OLD, NOW = MergeDefaults(), dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
DATA = "id int, dob string, name string, pts int"
WH1 = "WH_CreateDateTime_UTC timestamp_ntz, WH_ModifiedDateTime_UTC timestamp_ntz"
S, T, H = "d.s.src", "d.s.tgt", "d.s.his"


def run(spark, kind, source, target, target_schema, delete=False, history=None, **over):
    tables = {S: spark.createDataFrame(source, DATA + ", action string"), T: spark.createDataFrame(target, target_schema)}
    if history is not None:
        tables[H] = spark.createDataFrame(history, target_schema)
    config = MergeConfig("m", S, T, kind, "ID, dob", ignore="ACTION", delete_if_not_matched=delete, history=H if history is not None else None, **over)
    config = validate(config, D, lambda n: tables[n].columns if n in tables else None)
    return execute("M", {"m": config}, tables.__getitem__, NOW).tables


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("delete", [False, True])
def test_scd1(spark, delete):
    source = [(1, "a", "x", 1, ""), (2, "a", "new", 1, ""), (3, "a", None, 1, ""), (4, "a", "ins", None, ""), (None, "a", "n", 1, "")]
    target = [(1, "a", "x", 1, OLD, OLD), (2, "a", "old", 1, OLD, OLD), (3, "a", "was", 1, OLD, OLD), (9, "a", "left", 1, OLD, OLD), (None, "a", "n", 1, OLD, OLD)]
    want = [(1, "a", "x", 1, OLD, OLD), (2, "a", "new", 1, OLD, NOW), (3, "a", None, 1, OLD, NOW), (4, "a", "ins", None, NOW, NOW), (None, "a", "n", 1, NOW, NOW)]
    want += [] if delete else [(9, "a", "left", 1, OLD, OLD), (None, "a", "n", 1, OLD, OLD)]
    out = run(spark, "SCD1", source, target, f"{DATA}, {WH1}", delete)[T]
    assert got(out) == sorted(want, key=repr)
    again = run(spark, "SCD1", [r for r in source if r[0]], [r for r in got(out) if r[0]], f"{DATA}, {WH1}", delete)[T]
    assert got(again) == [r for r in got(out) if r[0]]


def test_scd1_refuses_equal_keys_and_takes_empty_tables(spark):
    with pytest.raises(ValueError):
        run(spark, "SCD1", [(1, "a", "x", 1, ""), (1, "a", "y", 1, "")], [], f"{DATA}, {WH1}")
    assert got(run(spark, "SCD1", [], [(1, "a", "x", 1, OLD, OLD)], f"{DATA}, {WH1}")[T]) == [(1, "a", "x", 1, OLD, OLD)]
    assert got(run(spark, "SCD1", [(1, "a", "x", 1, "")], [], f"{DATA}, {WH1}")[T]) == [(1, "a", "x", 1, NOW, NOW)]


WHV = "WH_CreateDateTime_UTC timestamp_ntz, WH_Version int, WH_isCurrent int, WH_isDeleted int"


def versions(spark, source, target, delete=True):
    return [(r.id, r.name, r.WH_Version, r.WH_isCurrent, r.WH_isDeleted) for r in sorted(run(spark, "SCD2Version", [(i, "d", n, 1, "") for i, n in source], target, f"{DATA}, {WHV}", delete)[T].collect(), key=lambda r: (r.id, r.WH_Version))]


def test_scd2_by_version(spark):
    target = [(1, "d", "x", 1, OLD, 1, 1, 0), (2, "d", "w", 1, OLD, 1, 0, 0), (2, "d", "y", 1, OLD, 2, 1, 0), (3, "d", "z", 1, OLD, 1, 1, 0)]
    source = [(1, "x2"), (2, "y"), (4, "w")]
    want = [(1, "x", 1, 0, 0), (1, "x2", 2, 1, 0), (2, "w", 1, 0, 0), (2, "y", 2, 1, 0), (3, "z", 1, 1, 1), (4, "w", 1, 1, 0)]
    assert versions(spark, source, target) == want
    assert versions(spark, source, target, False) == [(*r[:4], 0) for r in want]
    deleted = [(3, "d", "z", 1, OLD, 1, 1, 1)]
    assert versions(spark, [(3, "z")], deleted) == [(3, "z", 1, 1, 1)]
    assert versions(spark, [(3, "z2")], deleted) == [(3, "z", 1, 0, 1), (3, "z2", 2, 1, 0)]


def test_scd2_by_date_and_current(spark):
    end = dt.datetime(9999, 12, 31)
    for current in (False, True):
        kind = "SCD2DateAndCurrent" if current else "SCD2Date"
        schema = f"{DATA}, {WH1}, {'WH_isCurrent int, ' if current else ''}WH_isDeleted int, WH_RowEffectiveDateTime_UTC timestamp_ntz, WH_RowExpirationDateTime_UTC timestamp_ntz"
        row = lambda i, n, c, m, cur, deleted, a, b: (i, "d", n, 1, c, m, *([cur] if current else []), deleted, a, b)
        out = run(spark, kind, [(1, "d", "x2", 1, ""), (2, "d", "y", 1, "")], [row(1, "x", OLD, OLD, 1, 0, OLD, end), row(2, "y", OLD, OLD, 1, 0, OLD, end), row(3, "z", OLD, OLD, 1, 0, OLD, end)], schema, True)[T]
        want = [row(1, "x", OLD, NOW, 0, 0, OLD, NOW), row(1, "x2", NOW, NOW, 1, 0, NOW, end), row(2, "y", OLD, OLD, 1, 0, OLD, end), row(3, "z", OLD, NOW, 1, 1, OLD, end)]
        assert got(out) == sorted(want, key=repr)


def test_scd4(spark):
    schema = f"{DATA}, WH_CreateDateTime_UTC timestamp_ntz"
    out = run(spark, "SCD4", [(1, "d", "x2", 1, ""), (3, "d", "n", 1, "")], [(1, "d", "x", 1, OLD), (2, "d", "gone", 1, OLD)], schema, True, [(7, "d", "h", 1, OLD)])
    assert got(out[T]) == [(1, "d", "x2", 1, OLD), (3, "d", "n", 1, NOW)]
    assert got(out[H]) == [(1, "d", "x", 1, OLD), (2, "d", "gone", 1, OLD), (7, "d", "h", 1, OLD)]


def test_configurations():
    columns = {S: ["id", "dob", "name"], T: ["ID", "dob", "name", "WH_CreateDateTime_UTC", "WH_ModifiedDateTime_UTC"]}
    good = MergeConfig("m", S, T, "SCD1", " ID , dob,")
    checked = validate(good, D, columns.get)
    assert checked.keys() == ["ID", "dob"] and len(checked.warnings) == 2
    assert checked.ignored() == ["wh_createdatetime_utc", "wh_modifieddatetime_utc"] and checked.version is None and checked.utc_offset == 0
    assert list(upsert({"M": good}, good, D, columns.get)) == ["m"]
    bad = MergeConfig("m", "x", "a.b.none", "SCD2Version", "nokey", ignore="nocol")
    with pytest.raises(ValidationError) as e:
        validate(bad, D, columns.get)
    assert len(e.value.failures) >= 7
    for broken in (MergeConfig("m", S, T, "SCD1", "id", row_expiration_value="9999-12-31"), MergeConfig("m", S, T, "SCD9", "id")):
        with pytest.raises(ValidationError):
            resolve(broken, D)
    with pytest.raises(ValidationError):
        resolve(MergeConfig("m", S, T, "SCD2Date", "id"), MergeDefaults(row_expiration_value=None))
    assert resolve(MergeConfig("m", S, T, "SCD1", "id", utc_offset=480), D).now(NOW) == NOW + dt.timedelta(hours=8)


def test_dry_run_unknown_name_and_stored_rows(spark):
    tables = {S: spark.createDataFrame([(1, "a", "y", 1)], DATA), T: spark.createDataFrame([(1, "a", "x", 1, OLD, OLD), (2, "a", "x", 1, OLD, OLD)], f"{DATA}, {WH1}")}
    config = validate(MergeConfig("m", S, T, "SCD1", "id,dob"), D, lambda n: tables[n].columns)
    dry = execute("m", {"m": config}, tables.__getitem__, NOW, debug=True)
    assert got(dry.actions) == [("leave", 1), ("update", 1)] and "SCD1" in dry.text and not dry.tables
    assert execute("other", {"m": config}, tables.__getitem__, NOW) is None
    stored = spark.createDataFrame([(1, "a", "a.b.c", "a.b.c", None, "SCD1", "k"), (2, "A", "ab", "a.b.c", "x", None, " ")], "dynamicmergeconfigurationid int, mergeconfigurationname string, qualifiedsourcename string, qualifiedtargetname string, qualifiedtargethistoryname string, scdtype string, mergeoncolumns string")
    assert sorted(tuple(r) for r in configuration_checks(stored).collect()) == [(1, "mergeconfigurationname"), (2, "mergeconfigurationname"), (2, "mergeoncolumns"), (2, "qualifiedsourcename"), (2, "qualifiedtargethistoryname"), (2, "scdtype")]


def test_merging_a_stream(spark, tmp_path):
    target = VersionedTable(spark, f"{tmp_path}/t")
    target.write(spark.createDataFrame([(1, "a", "x", 1, OLD, OLD)], f"{DATA}, {WH1}"), 0)
    for n, row in enumerate([(1, "a", "y", 1), (2, "a", "z", 1)]):
        spark.createDataFrame([row], DATA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        config = resolve(MergeConfig("m", S, T, "SCD1", "id,dob"), D)
        stream = spark.readStream.schema(DATA).parquet(f"{tmp_path}/in")
        q = merge_stream(stream, config, target, lambda _: NOW).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert got(target.read()) == [(1, "a", "y", 1, OLD, NOW), (2, "a", "z", 1, NOW, NOW)]
    assert target.versions() == [0, 1, 2]
