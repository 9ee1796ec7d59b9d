"""What the planner makes of the queries: pruned scans, no needless shuffles, one Python pass."""

import re

from borespark.operators import frames
from borespark.plans import workload, workload_frames, workload_more, workload_sources, workload_traces  # noqa: F401
from borespark.sources.segy import read_volume, write_volume

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def query(spark, name):
    return plan(workload.QUERIES[name](spark, DATA))


def columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_formulas_scan_their_columns_and_stay_in_place(spark):
    text = query(spark, "p05_vshale_linear")
    assert "Exchange" not in text and columns(text) == [{"l_orderkey", "l_linenumber", "l_quantity"}]
    assert columns(query(spark, "f01_projection")) == [{"l_orderkey", "l_quantity"}]
    for name in ("v03_aki_richards", "p19_gassmann_vp", "v09_zoeppritz"):
        assert "Python" not in query(spark, name) and "Arrow" not in query(spark, name)


def test_filters_reach_the_scan(spark):
    rows = frames.row_window(spark.read.parquet(f"{DATA}/events.parquet"), "event_id", 10, 20)
    assert "GreaterThanOrEqual(event_id,10)" in plan(rows) and "LessThan(event_id,30)" in plan(rows)


def test_a_pipeline_is_one_arrow_pass(spark):
    text = query(spark, "t13_pipeline")
    assert text.count("MapInArrow") == 1 and "Exchange" not in text


def test_scaling_a_log_moves_no_rows(spark):
    """Only the statistics, a row per log and task, are shuffled."""
    text = query(spark, "p02_z_score")
    assert "Window" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "partial_" in text


def test_interpolation_makes_no_pairs(spark):
    for name in ("w14_interpolate", "j03_interval_join"):
        text = query(spark, name)
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" not in text


def test_tiles_prune_folders(spark, tmp_path):
    df = spark.range(64).selectExpr("id % 8 as il", "id div 8 as xl", "array(cast(id as double)) as amplitude")
    write_volume(df, str(tmp_path / "v"), tile=4)
    text = plan(read_volume(spark, str(tmp_path / "v"), il=(0, 3), tile=4))
    assert re.search(r"PartitionFilters: \[[^\]]*tile_i", text)


def test_traces_are_added_up_before_they_move(spark):
    """What is shuffled are sums per task; no row per trace and sample."""
    for name in ("g05_velocity_scan", "a12_collapse_profiles"):
        text = query(spark, name)
        assert text.count("MapInArrow") == 1 and text.index("Generate") < text.index("MapInArrow") and "Exchange" not in text[text.index("MapInArrow") :]
    for name in ("g01_nmo", "g02_stretch_mute", "k02_resample_trace"):
        assert "Exchange" not in query(spark, name) and query(spark, name).count("MapInArrow") == 1
    assert "Generate" not in query(spark, "a14_volume_error")
    for name in ("u01_refine_linear", "u02_refine_cubic"):
        assert query(spark, name).count("FlatMapGroupsInPandas") == 1


def test_no_window_without_keys(spark):
    for name in ("o02_natural_order", "d09_merge_intervals", "w14_interpolate"):
        assert "SinglePartition" not in query(spark, name)


def test_headers_of_tops_text_are_looked_for_once_per_file(spark, tmp_path):
    """Beside the generator they are looked for once per row, and the time grows with the square of a file's rows."""
    from borespark.sources import folder

    (tmp_path / "a_tops.txt").write_text("Well Name: W-1\nTop(m)\tBase(m)\tUnit\n10\t20\tU1\t\t\tx\n")
    (tmp_path / "b_tops.txt").write_text("Well Name: W-2\n10\t20\tU1\t\t\tx\n")  # without the line that rows follow
    rows = folder.read_tops_text(spark, str(tmp_path))
    above, below = plan(rows).split("Generate", 1)
    assert "Well Name" in below and "Well Name" not in above and below.count("array_position") == 1
    assert [(r["well"], r["name"], r["top_depth"]) for r in rows.collect()] == [("W-1", "U1", 10.0)]


def test_resampled_centres_are_neither_shuffled_nor_sorted(spark):
    """Only the rows of the logs are; their centres are made behind the last exchange, window and join."""
    text = query(spark, "j02_resample")
    assert text.count("Generate") == 1
    below = text[text.index("Generate") :]
    assert not re.search("Exchange|Window|Sort|Join", text[: text.index("Generate")]) and below.count("Window") == 2


def test_resampled_rows_are_shuffled_and_sorted_without_their_segments(spark):
    """They move and are put in order as narrow as they come; what a row carries of the channels is added behind that."""
    text = query(spark, "j02_resample")
    assert "struct(" in text and "struct(" not in text[text.index("Sort [") :]
