import json
from datetime import datetime

from test_profile import related

from starmill.functions.fingerprints import governance_fingerprint, schema_fingerprint
from starmill.plans import profiling


def test_report_and_json(spark, tmp_path):
    tables, keys = related(spark)
    path = str(tmp_path / "report.json")
    report = profiling.profile_sources(tables, output_path=path)
    assert report["candidate_unique_keys"] == keys
    assert report["duplicate_keys"] == {"buyers": 0, "yards": 0, "orders": 0}
    (relation,) = report["referential_integrity"]
    assert relation["parent_table"] == "buyers" and relation["orphan_count"] == 1
    assert report["tables"]["orders"]["columns"]["buyer_id"]["null_count"] == 1
    assert json.load(open(path))["tables"]["yards"]["row_count"] == 20
    assert profiling.profile_sources(tables, exact=False)["candidate_unique_keys"] == keys


def test_condensed_and_csv_sources(spark, tmp_path):
    lines = "\n".join(f"{i},{'abcdefg'[i % 7]}" for i in range(50))
    (tmp_path / "raw_things.csv").write_text("thing_id,kind\n" + lines + "\n")
    report = profiling.profile_sources(profiling.load_sources(spark, str(tmp_path)))
    assert report["candidate_unique_keys"] == {"things": ["thing_id"]}
    assert len(report["tables"]["things"]["columns"]["kind"]["value_counts"]) == 7
    short = profiling.condensed(report)["tables"]["things"]["columns"]["kind"]
    assert short["top_values"] == {"a": 8, "b": 7, "c": 7, "d": 7, "e": 7}


def test_unchanged_input_is_not_profiled_again(spark, lake, monkeypatch):
    tables, _ = related(spark)
    at = datetime(2024, 1, 1)
    first = profiling.profile_once(lake, tables, "b1", at)
    monkeypatch.setattr(profiling, "profile_sources", lambda *a: {"again": True})
    assert profiling.profile_once(lake, tables, "b1", at) == first
    assert profiling.profile_once(lake, tables, "b2", at) == {"again": True}
    assert lake.read("gold", profiling.CACHE).count() == 2


def test_fingerprints():
    tables = {"t": ["x", "y"], "s": ["z"]}
    a = schema_fingerprint(tables)
    assert a == schema_fingerprint({"s": ["z"], "t": ["x", "y"]}) != schema_fingerprint({"t": ["x"], "s": ["z"]})
    typed = schema_fingerprint({"t": {"x": "int"}})
    assert typed == schema_fingerprint({"t": {"x": "int"}}) != schema_fingerprint({"t": {"x": "string"}})
    rules = {"t": {"b": 1, "a": 2}}
    g = governance_fingerprint
    assert g(tables, rules) == g(tables, {"t": {"a": 2, "b": 1}}) != g(tables)
    assert g(tables, rules, "CREATE  x -- note\n(y);") == g(tables, rules, "CREATE x (y)")
