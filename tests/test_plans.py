"""Views, recipes and folder scans."""

import json

import pytest

from borespark.plans import recipes, views
from borespark.plans.registry import built_in
from borespark.sources import folder


@pytest.fixture
def channels(spark):
    return spark.createDataFrame([(1, 10.0, 2200.0, 1200.0, 2.15, 0.2), (1, 20.0, 2500.0, None, 2.22, 20.0), (1, 30.0, 2800.0, 1600.0, 2.28, 0.1)], "well int, depth double, vp double, vs double, rho double, phi double")


def test_crossplots(channels):
    assert len(views.CROSSPLOTS) == 9
    counts = {t: views.crossplot(channels, t, ["well"]).count() for t in views.CROSSPLOTS}
    assert counts["porosity-vs-vp"] == 3 and counts["pr-vs-ai"] == 2
    got = views.crossplot(channels, "vp-vs-vs", ["well"], "depth", ("depth", 15.0, 30.0)).collect()
    assert [(r["x"], r["y"], r["color"]) for r in got] == [(2800.0, 1600.0, 30.0)]


def test_well_panel(spark, channels):
    tops = spark.createDataFrame([(1, "A", 15.0), (1, "B", 25.0)], "well int, name string, top_depth double")
    got = {r["depth"]: r["name"] for r in views.well_panel(channels, tops, ["well"]).collect()}
    assert got == {10.0: None, 20.0: "A", 30.0: "B"}
    assert views.assets_covering(tops.select("well").distinct(), channels, ["well"], "depth", 5, 12).count() == 1


def test_reflectivity_views(spark):
    i = spark.createDataFrame([(1, 2190.0, 716.0, 2.118, 2760.0, 1473.0, 2.229)], "id int, vp1 double, vs1 double, rho1 double, vp2 double, vs2 double, rho2 double")
    r = views.reflectivity_response(i, [0, 20], ["shuey_two_term", "fatti"], ["id"])
    assert r.count() == 4
    row = views.chi_view(i, ["id"], 0.0).first()
    assert row["projection"] == pytest.approx(row["intercept"]) == pytest.approx(0.14068636)
    ops = {x["id"]: x["available"] for x in views.trace_operators(spark, "post_stack").collect()}
    assert ops["agc"] and ops["dip"] and not ops["nmo"]


def test_recipes(spark, tmp_path):
    spark.createDataFrame([(65.0, [1.0, -1.0])], "GR double, amplitude array<double>").write.parquet(str(tmp_path / "in"))
    recipe = {
        "version": 1, "id": "r", "name": "Shale", "inputs": [{"id": "w", "path": str(tmp_path / "in")}],
        "steps": [{"id": "v", "input": "w", "operator": "vshale_linear", "bindings": {"gr": "GR"}}, {"id": "t", "input": "v", "operator": "traces", "interval_ms": 4.0, "steps": [{"name": "scale", "parameters": {"factor": 3.0}}]}],
        "asserts": [{"table": "v", "condition": "value between 0 and 1"}, {"table": "t", "condition": "value > 1"}],
    }
    tables, report = recipes.run(spark, recipe)
    assert tables["t"].first()["amplitude"] == [3.0, -3.0] and report.failures == ["t: value > 1"]
    assert json.loads(report.to_json())["digest"] == recipes.digest(recipe) and "| v | vshale_linear |" in report.to_markdown()
    broken = recipe | {"version": 2, "name": " ", "steps": [{"id": "w", "input": "x", "operator": "no"}]}
    assert len(recipes.validate(broken, built_in())) == 7


def test_folder(spark, tmp_path):
    for name in ("a.las", "deviation_1.txt", "well_tops.txt", "x.SGY", "notes.doc", "v.vds"):
        (tmp_path / name).write_text("x")
    (tmp_path / "well_tops.txt").write_text("Well Name: W-1\nDepth Ref Point: KB\nSource: S\nTop(m)\tBase(m)\tUnit\ta\tb\tc\n10\t20\tU1\t\t\t\n30\t\t\t\t\t\nshort\n")
    files = folder.scan_folder(spark, str(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["imported"]) for r in files.collect()}
    assert kinds == {"a.las": ("log", True), "deviation_1.txt": ("trajectory", True), "well_tops.txt": ("tops", True), "x.SGY": ("traces", True), "notes.doc": ("other", False), "v.vds": ("vds", False)}
    assert folder.import_plan(files).where("family = 'tops'").first()["files"] == 1 and folder.detect_format("b/C.SEGY") == "traces"
    rows = folder.read_tops_text(spark, str(tmp_path / "well_tops.txt")).orderBy("top_depth").collect()
    assert [(r["well"], r["depth_reference"], r["name"], r["top_depth"], r["base_depth"], r["issue"]) for r in rows] == [("W-1", "KB", "U1", 10.0, 20.0, None), ("W-1", "KB", None, 30.0, None, "name is missing")]


def test_command_line(spark, tmp_path, capsys):
    from borespark.__main__ import main

    assert main(["operators"]) == 0 and "vshale_linear" in capsys.readouterr().out
    assert main(["trace-operators", "post_stack"]) == 0
    (tmp_path / "r.json").write_text(json.dumps({"version": 2}))
    assert main(["validate-recipe", str(tmp_path / "r.json")]) == 1 and "version" in capsys.readouterr().out
    (tmp_path / "a.las").write_text("x")
    assert main(["scan", str(tmp_path)]) == 0 and '"log"' in capsys.readouterr().out


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from borespark.plans.external import Host
host = Host()

@host.operator("twice")
def twice(request):
    curve = request["payload"]["inputs"]["v"]
    values = [None if v is None else v * request["parameters"]["factor"] for v in curve["values"]]
    return {{"curve_name": "v2", "original_mnemonic": "V2", "unit": None, "description": None, "semantic_type": "Unknown", "values": values}}

@host.operator("deeper")
def deeper(request):
    return [row | {{"top_depth": row["top_depth"] + 1}} for row in request["payload"]["rows"]]

@host.operator("short")
def short(request):
    return {{"curve_name": "v"}}

raise SystemExit(host.main())
"""


def test_external_operators(spark, tmp_path):
    import sys
    from pathlib import Path

    from borespark.plans import external

    script = tmp_path / "host.py"
    script.write_text(SCRIPT.format(root=str(Path(__file__).resolve().parents[1])))
    command = [sys.executable, str(script)]
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 1.0, None), (2, 1.0, 3.0)], "w int, d double, v double")
    got = external.run_log(df, command, "twice", ["w"], "d", {"v": "v"}, {"factor": 2.0}).collect()
    assert sorted((r["w"], r["d"], r["value"]) for r in got if r["v"] is not None) == [(1, 2.0, 10.0), (2, 1.0, 6.0)]
    assert [r["value"] for r in got if r["v"] is None] == [None]
    tops = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "w int, name string, top_depth double")
    rows = external.run_table(tops, command, "deeper", "top_set", ["w"]).collect()
    assert sorted((r["w"], r["name"], r["top_depth"], r["base_depth"]) for r in rows) == [(1, "a", 11.0, None), (2, "b", 21.0, None)]
    for operator, said in (("short", "a curve without"), ("unknown", "no operator unknown")):
        with pytest.raises(Exception, match=said):
            external.run_log(df, command, operator, ["w"], "d", {"v": "v"}).collect()


def test_packages_of_tables_and_capabilities(tmp_path):
    from borespark.plans import registry as reg

    r = reg.built_in()
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "version": "2", "operators": [{"id": "mine", "family": "tops", "keys": ["w"], "schema": "w int, n long"}]}))
    lock = reg.load_package(r, str(tmp_path / "p.json"), {"mine": lambda pdf: pdf})
    assert lock[0].startswith("mine@2:") and r.operators["mine"].subject == "top_set" and r.operators["mine"].lifecycle == "derived_asset"
    (tmp_path / "q.json").write_text(json.dumps({"name": "q", "version": "2", "operators": [{"id": "other", "family": "tops"}]}))
    with pytest.raises(ValueError, match="keys and schema"):
        reg.load_package(r, str(tmp_path / "q.json"), {"other": lambda pdf: pdf})
    c = reg.capabilities(r)
    assert "mine" in c.records and not c.records["hdf5"].available and "hdf5" not in [x.id for x in c.available()]
    c.add(reg.Capability("hdf5", "format"))
    assert len([x for x in c.of_kind("format") if x.id == "hdf5"]) == 1 and c.records["hdf5"].available


def test_commands(spark, tmp_path, capsys):
    from borespark.__main__ import main

    def said(*arguments):
        assert main(list(arguments)) == 0
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert {r["id"] for r in said("capabilities") if not r["available"]} == {"vds", "hdf5"}
    assert [r["code"] for r in said("search-crs", "32631")] == [32631]
    assert said("query", "a18_project_summary", "/root/testdata/sf0.001")[0]["wells"] == 25
    (tmp_path / "pressure.csv").write_text("md,pressure\n1,2\n")
    assert said("ingest", str(tmp_path), str(tmp_path) + "-out")[0]["rows"] == 1
