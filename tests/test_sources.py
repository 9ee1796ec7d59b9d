"""Readers and writers, the registry, the cache, streams; all inputs are made here."""

import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borespark.plans.registry import Family, Parameter, ResultCache, built_in, load_package
from borespark.operators.traces import Step, run_pipeline
from borespark.sources import folder, logs, segy, tables, zarr
from borespark.streaming.logs import derive, window_summary

LOG = """~VERSION
 VERS.   1.2 : CWLS
 WRAP.   NO  :
~WELL
 STRT.M  1670.0 :
 STOP.M  1669.75 :
 NULL.   -999.25 :
 COMP.   COMPANY : ACME OIL
~CURVE
 DEPT.M      : depth
 GR.GAPI     : gamma
 GR.GAPI     : gamma again
 .OHMM       : nameless
~Q private
 X.Y 1 : kept
~A
 1670.000 65.1 -999.25 1
 1669.875 1,5 2-3
 1669.750 7 8 (null)
"""


def test_log_file(spark, tmp_path):
    (tmp_path / "a.las").write_text(LOG)
    log = logs.parse_log(LOG)
    assert log.curves == ["DEPT", "GR:1", "GR:2", "UNKNOWN"] and log.null == -999.25
    assert ("COMP", "", "ACME OIL", "COMPANY") in log.sections["W"] and any("unknown section" in i for i in log.issues)
    assert log.rows[1] == ["1669.875", "1.5", "2", "-3"]
    df = logs.read_logs(spark, str(tmp_path))
    value = logs.apply_null_policy(F.col("raw"), "common", F.col("null_value"))
    rows = df.withColumn("value", logs.typed(value)).cache()
    assert rows.count() == 12 and rows.where("value is null").count() == 2
    wide = logs.wide(rows, ["DEPT", "GR:1"]).orderBy("row_idx").collect()
    assert [r["GR:1"] for r in wide] == [65.1, 1.5, 7.0]
    with pytest.raises(KeyError):
        logs.wide(rows, ["NO"])
    kinds = {r["curve"]: r["kind"] for r in logs.storage_kind(df, ["curve"]).collect()}
    assert kinds["GR:1"] == "Numeric" and kinds["UNKNOWN"] == "Mixed"
    head = logs.read_log_headers(spark, str(tmp_path))
    assert head.where("section = 'C'").count() == 4 and head.where("section = '!'").count() >= 1
    logs.write_package(rows.select("curve", "row_idx", "value"), str(tmp_path / "p"), partition=["curve"])
    assert logs.open_package(spark, str(tmp_path / "p")).where("curve = 'DEPT' and row_idx between 1 and 2").count() == 2


def test_null_policies(spark):
    cells = ["-999.25", "999.0", "(null)", "na", "-0.00", "1.#INF", "ERR", "7", "-1", "NaN"]
    df = spark.createDataFrame([(c,) for c in cells], "raw string")
    lost = {}
    for policy in logs.POLICIES:
        kept = {r[0] for r in df.select(logs.apply_null_policy(F.col("raw"), policy, F.lit(-1.0))).collect()}
        lost[policy] = {c for c in cells if c not in kept}
    assert lost["none"] == set() and lost["strict"] == {"-1", "NaN"}
    assert lost["common"] == lost["strict"] | {"-999.25", "(null)", "na", "1.#INF"}
    assert lost["aggressive"] == lost["common"] | {"999.0", "-0.00"} and lost["all"] == lost["aggressive"] | {"ERR"}


def test_log_variants():
    wrapped = LOG.replace("WRAP.   NO", "WRAP.   YES").replace(" 1670.000 65.1 -999.25 1\n", " 1670.000\n 65.1 -999.25\n 1\n").replace("2-3", "2 -3")
    assert [len(r) for r in logs.parse_log(wrapped).rows] == [4, 4, 4]
    with pytest.raises(ValueError):
        logs.parse_log(LOG.replace("1.2", "3.0"))
    with pytest.raises(ValueError):
        logs.parse_log(LOG + " 1 2 3 4 5\n")
    short = logs.parse_log(LOG.split("~A")[0] + "~A\n 1 2\n 3 4\n")
    assert short.rows == [["1", "2", None, None], ["3", "4", None, None]]
    with pytest.raises(ValueError):
        logs.parse_log(LOG.split("~A")[0] + "~A\n 1 2 3 4\n 3 4\n")
    with pytest.raises(ValueError):
        logs.parse_log(LOG.split("~A")[0] + "~A\n 1 2 3 4\n 1 2 *** 4\n")
    tail = logs.parse_log(wrapped + " 9 9\n")
    assert len(tail.rows) == 3 and any("no whole row" in i for i in tail.issues)
    assert logs._cells("1,, 2 ,\"x\"", "COMMA") == ["1", "2", '"x"'] and logs._cells("a\t\t'b\tc'd\t e\"f", "TAB") == ["a", "b\tcd", "ef"]
    assert logs.decode(b"\x80\x93\x81\xe9") == "€“\x81é"
    assert logs.decode(b"\xef\xbb\xbfabc") == "abc" and logs.decode("é".encode("latin-1")) == "é" and logs.decode("é".encode("utf-16")) == "é"


@pytest.mark.parametrize(
    ("line", "section", "want"),
    [
        (" DT .US/M  123 35 00 00 : 8  sonic: fast", "C", ("DT", "US/M", "123 35 00 00", "8  sonic: fast")),
        ("TCS . 23:15 23-JAN-2001 : Time Logger: At Bottom", "P", ("TCS", "", "23:15 23-JAN-2001", "Time Logger: At Bottom")),
        ("STRT.DateTime 2012-09-16T07:44:12-05:00 : START DEPTH", "W", ("STRT", "DateTime", "2012-09-16T07:44:12-05:00", "START DEPTH")),
        ("TDEP  ..1IN : 0.1-in", "C", ("TDEP", ".1IN", "", "0.1-in")),
        ("I. Res..OHM-M : Induction", "C", ("I. Res.", "OHM-M", "", "Induction")),
        ("DRILLED  :12/11/2010", "W", ("DRILLED", "", "12/11/2010", "")),
        ("HKLA.1000 lbf : (RT)", "P", ("HKLA", "1000 lbf", "", "(RT)")),
        ("RUN . 01 : RUN NUMBER", "P", ("RUN", "", "01", "RUN NUMBER")),
        ("TIME     :14:00:32", "", ("TIME", "", "14:00:32", "")),
        ("QI .[M] : GOOD", "P", ("QI", "M", "", "GOOD")),
        ("X.M. 5", "P", ("X", "M", "5", "")),
        ("  ", "P", None),
        ("NULL.    -999.25", "W", ("NULL", "", "-999.25", "")),
        ("RUN.1000", "P", ("RUN", "1000", "", "")),
        ("A..B c", "P", ("A", ".B", "c", "")),
        ("lone word", "P", ("lone", "", "word", "")),
        ("X.(ft) 1:2:3", "P", ("X", "ft", "1:2", "3")),
    ],
)
def test_header_lines(line, section, want):
    assert logs.header_item(line, section) == want


@pytest.mark.parametrize("code", [1, 2, 3, 5, 6, 8])
@pytest.mark.parametrize("big", [True, False])
def test_segy_round_trip(spark, tmp_path, code, big):
    r = np.random.default_rng(code)
    data = [np.clip(np.round(r.normal(size=50) * 40), -128, 127) if code in (2, 3, 8) else r.normal(size=50) * 10.0 for _ in range(23)]
    heads = pd.DataFrame({"inline": [i // 5 for i in range(23)], "crossline": [i % 5 for i in range(23)], "offset": 100})
    path = str(tmp_path / "x.sgy")
    segy.write_segy(data, heads, path, 4000, code, big)
    layout = segy.inspect(path)
    assert (layout.big_endian, layout.format, layout.samples, layout.traces, layout.interval_us) == (big, code, 50, 23, 4000)
    rows = segy.read_traces(spark, path, chunk=7).orderBy("trace").collect()
    assert [(x["inline"], x["crossline"]) for x in rows] == [(i // 5, i % 5) for i in range(23)]
    assert all(np.allclose(x["amplitude"], d, rtol=2e-6, atol=1e-5) for x, d in zip(rows, data, strict=True))
    p = segy.preflight(segy.read_traces(spark, path, ("inline", "crossline"), samples=False)).first()
    assert p["kind"] == "regular_sparse" and p["missing"] == 2 and p["action"] == "regularise"


def test_volume_store_prunes(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).alias("il"), F.floor(F.col("id") / 20).alias("xl"), F.array(F.col("id").cast("double")).alias("amplitude"))
    segy.write_volume(df, str(tmp_path / "v"), tile=8)
    got = segy.read_volume(spark, str(tmp_path / "v"), (3, 5), (10, 11), tile=8)
    assert got.count() == 6 and "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    segy.sections_to_csv(df.where("il = 1"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 20


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("MD,Inc,AZI\n10,1.5,370\n20,,x\n")
    got = tables.read_family(spark, str(tmp_path / "t.csv"), "trajectory").collect()
    assert [(r["md"], r["inclination"], r["azimuth"]) for r in got] == [(10.0, 1.5, 370.0), (20.0, None, None)]
    with pytest.raises(ValueError):
        tables.read_family(spark, str(tmp_path / "t.csv"), "tops")
    (tmp_path / "m.csv").write_text("Top_Name,Top,Reference,Depth_Domain\nA,10,KB,\nB,20,,TVD\nC,30,,\n")
    m = tables.read_family(spark, str(tmp_path / "m.csv"), "tops").orderBy("name").collect()
    assert [(r["depth_domain"], r["depth_datum"]) for r in m] == [("md", "kb"), ("tvd", None), (None, None)]
    (tmp_path / "h.xyz").write_text("# c\n1 2 3\n4,5,6\n// x\n\n7;8;nine\n")
    h = tables.read_horizon(spark, str(tmp_path / "h.xyz"))
    assert h.count() == 3 and tables.horizon_issues(h).count() == 1
    (tmp_path / "s.txt").write_text("-0.5 100 A\n-0.5 100 A\n0.2 50 A\n")
    assert [tuple(r) for r in tables.read_checkshots(spark, str(tmp_path / "s.txt")).collect()] == [("A", 50.0, 0.2), ("A", 100.0, 0.5)]
    (tmp_path / "z.txt").write_text("10 0.01\n10 0.02\n5 0.005\n")
    assert [tuple(r) for r in tables.read_time_depth(spark, str(tmp_path / "z.txt")).collect()] == [(5.0, 5.0), (10.0, 10.0)]
    (tmp_path / "v.txt").write_text("0 0 100 1600\n0 0 50 1500\n1 0 50 1700\n")
    v = {(r["x"], r["y"]): (r["times"], r["velocities"]) for r in tables.read_velocity_functions(spark, str(tmp_path / "v.txt")).collect()}
    assert v[0.0, 0.0] == ([50.0, 100.0], [1500.0, 1600.0])


def test_registry(spark, tmp_path):
    r = built_in()
    assert r.catalog(spark).count() == len(r.operators) >= 24
    curves = spark.createDataFrame([(1, "gamma_ray"), (1, "depth"), (2, "depth"), (3, "p_velocity"), (3, "s_velocity")], "asset int, kind string")
    a = {(x["asset"], x["operator"]): (x["available"], x["reason"]) for x in r.availability(curves).collect()}
    assert a[1, "vshale_linear"] == (True, None) and a[2, "vshale_linear"] == (False, "no curve for gr") and a[3, "lambda_rho"] == (False, "no curve for rho") and not a[2, "gap_flag"][0]
    df = spark.createDataFrame([(65.0,)], "GR double")
    out, manifest = r.execute("vshale_linear", df, {"gr": "GR"}, {"low": 30.0})
    assert out.first()["value"] == 0.5 and manifest.parameters == {"low": 30.0, "high": 100.0} and len(manifest.digest) == 64
    for bad in ({"nope": 1}, {"low": "x"}):
        with pytest.raises(ValueError):
            r.execute("vshale_linear", df, {"gr": "GR"}, bad)
    r.user_log_operator("double", lambda s, times: s * times, (Parameter("times", default=2.0),))
    assert r.execute("double", df, {"curve": "GR"})[0].first()["value"] == 130.0
    r.user_table_operator("first", Family.TOPS, lambda p: p.head(1), "GR double", ["GR"])
    assert r.execute("first", df)[0].count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "version": "2", "operators": [{"id": "plus", "family": "log"}]}))
    assert load_package(r, str(tmp_path / "p.json"), {"plus": lambda s: s + 1})[0].startswith("plus@2:")


def test_result_cache(spark, tmp_path):
    cache, steps = ResultCache(spark, str(tmp_path)), [Step("scale", {"factor": 2.0}), Step("rms_normalise")]
    df = spark.createDataFrame([([1.0, 2.0],)], "amplitude array<double>")
    cache.put("s", steps[:1], run_pipeline(df, steps[:1], 4.0))
    n, stored = cache.longest_prefix("s", steps)
    assert n == 1 and stored.first()["amplitude"] == [2.0, 4.0] and cache.longest_prefix("t", steps) == (0, None)


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    rows = window_summary(derive(stream, {"double": F.col("value") * 2}), ["event_type"], "ts", "double")
    q = rows.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from sums").first()[0] == source.count()


def survey(n_il=6, n_xl=5, offsets=(0,), drop=()):
    """Headers and traces of a small survey."""
    r = np.random.default_rng(4)
    heads = [{"inline": 10 + i, "crossline": 20 + x, "offset": o} for i in range(n_il) for x in range(n_xl) for o in offsets if (i, x) not in drop]
    return [r.normal(size=12) for _ in heads], pd.DataFrame(heads)


def test_ingest_checks_the_geometry(spark, tmp_path):
    dense, gathers, sparse = (str(tmp_path / n) for n in ("dense.sgy", "gathers.sgy", "sparse.sgy"))
    for path, options in ((dense, {}), (gathers, {"offsets": (100, 200)}), (sparse, {"drop": ((1, 1), (2, 3))})):
        segy.write_segy(*survey(**options), path, 4000, code=5)
    assert segy.ingest_volume(spark, dense, str(tmp_path / "v"))["kind"] == "regular_dense"
    assert segy.read_volume(spark, str(tmp_path / "v")).where("occupied").count() == 30
    with pytest.raises(ValueError, match="prestack"):
        segy.ingest_volume(spark, gathers, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no trace"):
        segy.ingest_volume(spark, sparse, str(tmp_path / "x"), sparse="refuse")
    assert segy.ingest_volume(spark, sparse, str(tmp_path / "s"))["missing"] == 2
    s = segy.read_volume(spark, str(tmp_path / "s"))
    assert s.count() == 30 and s.where("not occupied").count() == 2
    with pytest.raises(ValueError, match="offset axis"):
        segy.ingest_gathers(spark, dense, str(tmp_path / "x"))
    segy.ingest_gathers(spark, gathers, str(tmp_path / "g"))
    assert segy.read_gathers(spark, str(tmp_path / "g"), il=(11, 12)).count() == 20
    with pytest.raises(ValueError, match="regular"):
        segy.write_segy(*survey(offsets=(1, 2), drop=((0, 0),)), str(tmp_path / "h.sgy"), 4000, code=5)
        segy.ingest_gathers(spark, str(tmp_path / "h.sgy"), str(tmp_path / "x"))
    segy.ingest_velocity(spark, dense, str(tmp_path / "vel"), "time", "km/s", 0.0, 4.0)
    v = spark.read.parquet(str(tmp_path / "vel/velocity")).join(segy.read_traces(spark, dense).withColumnsRenamed({"inline": "il", "crossline": "xl"}), ["il", "xl"])
    assert v.where("abs(velocity[3] - 1000 * amplitude[3]) > 1e-9 or domain <> 'time'").count() == 0


def test_export_keeps_headers(spark, tmp_path):
    traces_, heads = survey()
    path, copy_ = str(tmp_path / "a.sgy"), str(tmp_path / "b.sgy")
    segy.write_segy(traces_, heads.assign(year=2001, source_x=-123456, cdp=7), path, 2000, code=1)
    kept = segy.read_traces(spark, path, (), chunk=7, raw=True)
    assert segy.export_traces(kept, copy_, segy.inspect(path)) == 30
    assert (tmp_path / "a.sgy").read_bytes() == (tmp_path / "b.sgy").read_bytes()
    moved = kept.withColumn("inline", (F.col("trace") + 500).cast("int"))
    segy.export_traces(moved, copy_, segy.inspect(path), ["inline"])
    rows = segy.read_stored(spark, copy_, ("inline", "year", "source_x", "cdp")).orderBy("trace").collect()
    assert [r["inline"] for r in rows] == list(range(500, 530)) and {(r["year"], r["source_x"], r["cdp"]) for r in rows} == {(2001, -123456, 7)}
    elsewhere = segy.read_traces(spark, path, {"year": (157, 2)}, samples=False)
    assert {r["year"] for r in elsewhere.collect()} == {2001}
    with pytest.raises(ValueError, match="the table"):
        segy.export_traces(kept.where("trace > 0"), copy_, segy.inspect(path))


def test_zarr_windows_and_chunks(spark, tmp_path):
    r = np.random.default_rng(3)
    cube = r.normal(size=(10, 7, 9))
    rows = spark.createDataFrame([(i, x, cube[i, x].tolist() if (i, x) != (4, 4) else None) for i in range(10) for x in range(7)], "il int, xl int, amplitude array<double>")
    path = str(tmp_path / "a.zarr")
    zarr.write_volume(rows, path, (10, 7, 9), (4, 3), dtype="<f8")
    got = {(t["il"], t["xl"]): t["amplitude"] for t in zarr.read_volume(spark, path, il=(3, 9), xl=(2, 5), samples=(1, 8)).collect()}
    assert set(got) == {(i, x) for i in range(3, 9) for x in range(2, 5)}
    assert all(np.allclose(v, cube[k][1:8]) for k, v in got.items() if k != (4, 4)) and got[4, 4] is None
    assert zarr.estimate(zarr.read_meta(spark, path), il=(3, 9)) == {"traces": 42, "chunks": 9, "bytes": 42 * 9 * 8}
    cut_ = tmp_path / "b.zarr"  # chunks that cut the sample axis, one missing
    cut_.mkdir()
    (cut_ / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 2, 5], "chunks": [1, 2, 3], "dtype": ">i2", "compressor": {"id": "zlib"}, "order": "C", "filters": None, "fill_value": 0}))
    whole = np.arange(20).reshape(2, 2, 5)
    for i in range(2):
        for t in range(2):
            if (i, t) != (1, 1):
                part = np.zeros((1, 2, 3), ">i2")
                own = whole[i : i + 1, :, 3 * t : 3 * t + 3]
                part[:, :, : own.shape[2]] = own
                (cut_ / f"{i}.0.{t}").write_bytes(zlib.compress(part.tobytes()))
    got = {(t["il"], t["xl"]): t["amplitude"] for t in zarr.read_volume(spark, str(cut_)).collect()}
    assert got[0, 1] == [5, 6, 7, 8, 9] and got[1, 0] == [10, 11, 12]
    (cut_ / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 2, 5], "chunks": [1, 2, 3], "dtype": "<f4", "compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError, match="blosc"):
        zarr.read_meta(spark, str(cut_))


def test_velocity_rows(spark, tmp_path):
    def rows(text, kind="interval"):
        (tmp_path / "v.txt").write_text(text)
        return [tuple(r) for r in tables.read_velocity_rows(spark, str(tmp_path / "v.txt"), kind).drop("line").collect()]

    assert rows("# note\nCDP-X CDP-Y TIME\nheading only\n1, 2, 100, 1500\n1 2 200 1600 1700 1650 180\n", "rms") == [(1, 2, 100, 1500, None, None, None), (1, 2, 200, 1600, 1700, 1650, 180)]
    for bad in ("1 2 100\n", "1 2 100 1500 x\n", "1 2 -1 1500\n", "1 2 100 0\n", "1 2 3 4 5\n"):
        with pytest.raises(Exception, match="not a velocity row"):
            rows(bad)
    with pytest.raises(ValueError):
        tables.read_velocity_rows(spark, "x", "other")


def test_folder_import(spark, tmp_path):
    well = tmp_path / "well"
    well.mkdir()
    (well / "a.las").write_text(LOG)
    (well / "deviation.txt").write_text("Well: X\nDepth(m)\tInc\tAzi\n0\t0\t10\n100\t5\t\n200\t\t30\n300\t1\t2\n")
    (well / "survey2.txt").write_text("Depth(m)\tInc\n0\t0\n")
    (well / "pressure.csv").write_text("md,pressure\n1,2\n")
    (well / "drilling.csv").write_text("md,nothing\n1,2\n")
    (well / "notes.pdf").write_text("x")
    said = {r["kind"]: r for r in folder.commit_folder(spark, str(well), str(tmp_path / "out")).collect()}
    assert said["log"]["rows"] == 12 and said["pressure"]["rows"] == 1 and said["other"]["issue"] == "left out"
    assert said["trajectory_text"]["rows"] == 4 and "event_kind" in said["drilling"]["issue"] and said["drilling"]["table"] is None
    surveys = {r["file"].split("/")[-1]: r["usable"] for r in folder.usable_surveys(folder.read_deviation_text(spark, str(well / "*.txt"))).collect()}
    assert surveys == {"deviation.txt": True, "survey2.txt": False}
    assert spark.read.parquet(str(tmp_path / "out/trajectory_text")).where("md = 100 and azimuth is null").count() == 1


def test_headers_alone_and_formats_by_content(spark, tmp_path):
    broken = LOG + " 1 2 3 4 5 6\n"  # rows that can't be read don't matter for the headers
    (tmp_path / "a.las").write_text(broken)
    assert logs.read_log_headers(spark, str(tmp_path / "a.las")).where("section = 'C'").count() == 4
    (tmp_path / "log").write_text(LOG)
    segy.write_segy(*survey(), str(tmp_path / "traces"), 4000, code=5)
    (tmp_path / "other").write_text("x" * 5000)
    zarr.write_volume(spark.createDataFrame([(0, 0, [1.0])], "il int, xl int, amplitude array<double>"), str(tmp_path / "store"), (1, 1, 1), (1, 1))
    assert [folder.detect_format(str(tmp_path / n)) for n in ("log", "traces", "other", "store", "x.sgy")] == ["log", "traces", "other", "volume", "traces"]
    assert folder.ingest(spark, str(tmp_path / "traces"), str(tmp_path / "v1")).first()["rows"] == 30
    assert folder.ingest(spark, str(tmp_path / "store"), str(tmp_path / "v2")).first()["rows"] == 1
    segy.transcode_volume(spark, str(tmp_path / "v1"), str(tmp_path / "v3"))
    assert segy.read_volume(spark, str(tmp_path / "v3")).exceptAll(segy.read_volume(spark, str(tmp_path / "v1"))).isEmpty()
    group = tmp_path / "g.mdio" / "data"
    zarr.write_volume(spark.createDataFrame([(0, 0, [1.0])], "il int, xl int, amplitude array<double>"), str(group / "chunked_012"), (1, 1, 1), (1, 1))
    assert zarr.read_mdio(spark, str(tmp_path / "g.mdio")).count() == 1
    with pytest.raises(ValueError, match="more than"):
        zarr.read_mdio(spark, str(tmp_path / "g.mdio"), most_bytes=3)


def test_output_packages(spark, tmp_path):
    from borespark.plans.registry import Manifest, open_output, write_output

    manifest = Manifest("agc", "1", {"window_ms": 500.0}, {"curve": "v"}, "d")
    write_output(spark.range(50).repartition(3), str(tmp_path / "p"), manifest)
    df, back = open_output(spark, str(tmp_path / "p"))
    assert df.count() == 50 and back == manifest
    spark.range(1).write.mode("append").parquet(str(tmp_path / "p" / "data"))
    with pytest.raises(ValueError, match="changed"):
        open_output(spark, str(tmp_path / "p"))


def test_presets(tmp_path):
    from borespark.operators.traces import load_presets, save_presets

    save_presets(str(tmp_path / "p.json"), {"a": [Step("agc", {"window_ms": 100.0}), Step("envelope")]})
    assert [s.name for s in load_presets(str(tmp_path / "p.json"), 4.0)["a"]] == ["agc", "envelope"]
    save_presets(str(tmp_path / "p.json"), {"a": [Step("bandpass", {"f1": 1.0, "f2": 2.0, "f3": 100.0, "f4": 200.0})]})
    with pytest.raises(ValueError):
        load_presets(str(tmp_path / "p.json"), 4.0)
