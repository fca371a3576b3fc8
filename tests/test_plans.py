import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeframe import queries as core
from gaugeframe.functions import geometry as g
from gaugeframe.plans import pipeline as pl
from gaugeframe.streaming import running


@pytest.fixture
def px(spark):
    return spark.createDataFrame([("i", y, x, (x * 40) % 256) for y in range(5) for x in range(6)], "image_id string, y int, x int, v int")


def test_parameters_are_strict():
    known = {"size": (int, 3), "kind": (("Box", "Median"), "Box"), "on": (bool, False), "f": (float, 0.0)}
    assert pl.bind({" SIZE ": "5", "kind": "median", "on": "True"}, known) == {"size": 5, "kind": "Median", "on": True, "f": 0.0}
    for bad in ({"sise": "1"}, {"size": "x"}, {"f": "nan"}, {"f": "inf"}, {"kind": "Gauss"}, {"on": "1"}):
        with pytest.raises(ValueError):
            pl.bind(bad, known)
    with pytest.raises(ValueError):
        pl.bind([("size", "1"), ("Size", "2")], known)


def test_tool_names():
    assert pl.normal_name(" Edge_Detection Tool ") == "edgedetection" and pl.normal_name("Affine Matrix") == "affinetransform"
    with pytest.raises(ValueError):
        pl.create(pl.Step("nothing"))
    for bad in ({"low": "300"}, {"low": "9", "high": "3"}, {"size": "4"}):
        with pytest.raises(ValueError):
            pl.create(pl.Step("threshold", bad))


def test_run_stops_and_saves(px):
    layers = pl.Layers(Source=px)
    steps = [
        pl.Step("threshold", {"low": "100"}, "SOURCE", "binary"),
        pl.Step("morphology", {"op": "erode"}, "Binary", "", acceptance=pl.Acceptance(metric="MEAN", minimum=300.0)),
        pl.Step("filter", {}, "binary", "never"),
    ]
    got = pl.run(steps, layers)
    assert [r.status for r in got] == ["Passed", "Failed", "Skipped"] and "< 300" in got[1].message
    assert layers.get("BINARY") is not None and layers.get("never") is None
    assert pl.load(pl.dump(steps)) == steps
    with pytest.raises(ValueError):
        pl.load('[{"tool": "x", "colour": "red"}]')


def test_expected_failure_is_last(px):
    fail = pl.Acceptance(expected_success=False, message_contains="No Layer")
    assert pl.run([pl.Step("filter", {}, "missing", acceptance=fail)], pl.Layers(source=px))[0].status == "Passed"
    with pytest.raises(ValueError):
        pl.run([pl.Step("filter", {}, "missing", acceptance=fail), pl.Step("filter")], pl.Layers(source=px))
    with pytest.raises(ValueError):
        pl.run([pl.Step("filter", enabled=False)], pl.Layers(source=px))


def test_every_tool_runs(px):
    for name, p in (("threshold", {"mode": "adaptive"}), ("filter", {"kind": "Median"}), ("edge", {"kind": "Scharr"}), ("edge", {"kind": "Laplacian"}), ("preprocess", {"invert": "true"}), ("Rotate And Scale", {"scale": "200"}), ("affine", {"width": "6", "height": "5"})):
        assert pl.create(pl.Step(name, p))(px).count() > 0
    pl.register("My Tool", pl.Tool({"k": (int, 1)}, lambda d, p: d.withColumn("v", F.col("v") * p["k"])))
    assert pl.create(pl.Step("my", {"k": "0"}))(px).agg(F.max("v")).first()[0] == 0


def test_acceptance_lists_all_reasons():
    rule = pl.Acceptance(True, "ok", "mean", 1.0, 2.0, 5.0)
    got = pl.evaluate(rule, pl.ToolResult(None, False, "bad", lambda: {"Mean": 3.0}, 9.0))
    assert len(got) == 4
    assert pl.evaluate(rule, pl.ToolResult(None, True, "All OK", lambda: {}, 0.0)) == ["no metric 'mean'"]


def test_combined_runner():
    def broken():
        raise RuntimeError("x")

    ok, rows = pl.combined([("a", lambda: True), ("b", None)], [("c", broken), ("d", lambda: False)])
    assert not ok and [r["status"] for r in rows] == ["Passed", "ConfigurationError", "Exception", "Failed"]
    assert pl.combined([], []) == (False, []) and pl.combined([("a", lambda: True)], [])[0]


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.running_repeatability(running.read_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rep").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_type: (r.n, r.mean_v) for r in spark.table("rep").collect()}
    want = {r.event_type: (r.n, r.mean_v) for r in running.running_repeatability(batch).collect()}
    assert got.keys() == want.keys()
    for k, (n, m) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(m)


def test_windowed_stream_runs(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    out = running.windowed(running.read_events(spark, str(tmp_path / "in")))
    q = out.writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").columns == ["start", "event_type", "n", "mean_v", "std_v", "range_v", "n_below", "n_above"]


def test_functions(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(
        g.line_intersection([F.lit(v) for v in (0, 0, 4, 4)], [F.lit(v) for v in (0, 4, 4, 0)]).alias("x"),
        g.line_intersection([F.lit(v) for v in (0, 0, 4, 4)], [F.lit(v) for v in (1, 0, 5, 4)]).alias("none"),
        g.vertex_angle(*lit(1, 0, 0, 0, 0, 1)).alias("a"), g.bearing360(*lit(0, 0, 0, -1)).alias("b"),
        g.in_polygon(*lit(0.5, 0.5), [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]).alias("i"),
        g.in_polygon(*lit(1.5, 0.5), [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]).alias("o"),
        g.pair_dimensions(lit(1, 2, 3), lit(4, 6, 7)).alias("p"), g.pair_dimensions(lit(1, 1, 1), lit(1, 1, 1)).alias("q"),
        g.three_point_plane(lit(0, 0, 0), lit(1, 1, 1), lit(2, 2, 2)).alias("flat"),
        g.line_approach(lit(0, 0, 0), lit(1, 0, 0), lit(0, 0, 3), lit(0, 1, 0)).alias("l"),
        g.line_approach(lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0), lit(1, 0, 0)).alias("par"),
        g.binary_text(F.lit(5).cast("long"), 8).alias("bits"), g.parse_rect(F.lit("1, 2,3,4")).alias("rect"), g.parse_rect(F.lit("1,2,x,4")).alias("bad"),
    ).first()
    assert tuple(r.x) == (2.0, 2.0) and r.none is None and r.a == pytest.approx(90) and r.b == pytest.approx(270) and r.i and not r.o
    assert r.p.distance == pytest.approx(41**0.5) and r.p.width == pytest.approx(5) and r.p.axial == 4 and r.q is None and r.flat is None
    assert r.l.gap == pytest.approx(3) and r.l.angle == pytest.approx(90) and r.par is None
    assert r.bits == "00000101" and tuple(r.rect) == (1, 2, 3, 4) and r.bad is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.SQL) <= set(core.QUERIES)


def test_core_stands_without_the_subpackage(monkeypatch):
    import importlib

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("gaugeframe.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith(("gaugeframe.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    import gaugeframe

    monkeypatch.delattr(gaugeframe, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    again = importlib.reload(entry)
    try:
        assert set(again.queries()) == set(core.QUERIES) and set(again.oracle_sql()) == set(core.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_status_of_codes(spark):
    got = {r.code: (r.status_2d, r.status_3d) for r in core.QUERIES["l4_result_status"](spark, "").collect()}
    assert got[0] == ("Passed", "Passed") and got[110] == ("InvalidRoi", "InvalidRoi") and got[120] == ("InvalidParameter", "InvalidParameter")
    assert got[403] == ("Failed", "Failed") and got[131] == ("ConfigurationError", "InsufficientData") and got[301][0] == "Canceled" and got[1016][0] == "Failed"


ORACLES = ["d1_thickness", "d2_warpage", "d7_distribution", "e2_outliers", "e3_edges_across", "j3_sobel", "i5_regrid", "c7_mesh_edges", "f9_threshold_candidates", "h18_three_point_plane"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = core.QUERIES[name](spark, small)
    want = c.execute(core.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    assert sorted(map(key, map(tuple, got.select(names).collect())), key=repr) == sorted(map(key, want.fetchall()), key=repr)


@pytest.fixture(scope="module")
def ragged(spark, small, tmp_path_factory):
    """The small embeddings up to a last set of 54 points."""
    d = str(tmp_path_factory.mktemp("ragged"))
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 454").write.parquet(f"{d}/embeddings.parquet")
    return d


def differences(spark, d, name):
    """Rows of the query alone, and of its SQL alone."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    got = core.QUERIES[name](spark, d)
    want = c.execute(core.SQL[name])
    got = Counter(map(tuple, got.select([k[0] for k in want.description]).collect()))
    want = Counter(want.fetchall())
    return got - want, want - got


def test_surface_selection_of_a_short_last_mesh(spark, ragged):
    assert differences(spark, ragged, "b16_surface_selection") == (Counter(), Counter())


def test_parts_outside_a_short_last_grid(spark, ragged):
    assert differences(spark, ragged, "c10_cell_assignment") == (Counter(), Counter())
    got = core.QUERIES["c10_cell_assignment"](spark, ragged).where("grid_id = 'g4'").collect()
    assert {r.part_row for r in got} == set(range(5)) and len(got) == 5 * 6


def test_vertices_of_a_short_last_mesh(spark, ragged, tmp_path):
    assert differences(spark, ragged, "c6_vertex_lookup") == (Counter(), Counter())
    spark.read.parquet(f"{ragged}/embeddings.parquet").where("vec_id % 100 <> 37").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert differences(spark, str(tmp_path), "c6_vertex_lookup") == (Counter(), Counter())


def test_edges_of_a_short_last_mesh(spark, ragged):
    assert differences(spark, ragged, "c7_mesh_edges") == (Counter(), Counter())
    last = core.QUERIES["c7_mesh_edges"](spark, ragged).where("mesh_id = 's4' AND hi >= 53").collect()
    assert [(r.lo, r.hi, r.owners, r.kind) for r in sorted(last)] == [(51, 53, 1, "Boundary"), (52, 53, 1, "Boundary")]
