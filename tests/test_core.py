import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointtide.functions import bits, colour, geometry, timeaxis
from pointtide.operators import drift, frames, islands, modifiers, profile, quantile, ranking, spatial, spikes
from pointtide.operators.graph import connected_components, min_labels
from pointtide.operators.ordered import carry_forward


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_by_both_ways(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    one, many = rows(connected_components(df)), rows(connected_components(df, one_task_links=0))
    assert one == many
    a, b = zip(*[e for e in edges if None not in e])
    label = min_labels(200, np.array(a), np.array(b))
    assert all(label[n] == c for n, c in one)
    assert not connected_components(df.where("false")).collect()


def test_chain_and_star(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src bigint, dst bigint")
    star = spark.createDataFrame([(1000, 1001 + i) for i in range(100)], "src bigint, dst bigint")
    got = dict(rows(connected_components(chain.union(star), one_task_links=0)))
    assert {got[i] for i in range(61)} == {0} and {got[1001 + i] for i in range(100)} == {1000}


@pytest.mark.parametrize("light", [1, 10_000])
def test_grouped_median(spark, light):
    random.seed(1)
    data = [(g, random.choice([random.gauss(0, 10 ** random.randint(-3, 6)), 0.0, -0.0, 5.0])) for g in (1, 2, None) for _ in range(random.randint(50, 80))] + [(9, None), (8, 1.0), (8, 2.0)]
    got = dict(rows(quantile.grouped_median(spark.createDataFrame(data, "g int, v double"), ["g"], ["v"], light_rows=light)))
    for g in {g for g, _ in data}:
        v = [x for k, x in data if k == g and x is not None]
        assert (got[g] is None and not v) or got[g] == pytest.approx(statistics.median(v), abs=0)


def test_carry_forward_over_blocks(spark):
    data = [(1, i, v) for i, v in enumerate([None, "a", None, None, "b", None, None, None, "c", None])]
    df = spark.createDataFrame(data, "g int, i int, v string")
    got = [r["w"] for r in carry_forward(df, ["g"], "i", F.col("v"), "w", block=3).orderBy("i").collect()]
    assert got == [None, None, "a", "a", "a", "b", "b", "b", "b", "c"]


def test_constant_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 8)
    data = [(1, i, 5.0 if 5 <= i < 11 else float(i), i) for i in range(20)] + [(2, i, 1.0, 100 + i) for i in range(5)] + [(3, i, None, 200 + i) for i in range(9)] + [(4, 2 * i, 1.0, 300 + i) for i in range(9)]
    df = spark.createDataFrame(data, "g int, o int, v double, k int")
    assert sorted(r[0] for r in rows(spikes.constant_runs(df, ["g"], "o", ["v"], 6, "k"))) == list(range(5, 11))


def test_robust_components():
    rng = np.random.default_rng(0)
    low = rng.normal(size=(20, 1)) @ rng.normal(size=(1, 24))
    sparse = np.zeros((20, 24))
    sparse[3, 4], sparse[10, 20] = 9, -8
    a, b = spikes.robust_components((low + sparse)[None])
    assert np.abs(a[0] - low).max() < 0.2 and abs(b[0][3, 4] - 9) < 0.5


def _faulty(spark, splats=(), trajectories=(), blocks=()):
    s = spark.createDataFrame(list(splats), "splat_id bigint, capture_id bigint, chunk_id bigint, record_id int, positions array<float>, scales array<float>, observed_at timestamp_ntz, key string, field string")
    t = spark.createDataFrame(list(trajectories), "vec_id bigint, capture_id bigint, positions array<float>, ingested_at timestamp_ntz, source int")
    b = spark.createDataFrame(list(blocks), "block_id bigint, capture_id bigint, chunk_index int, group_no int, trajectory_min double, trajectory_max double, ingested_at timestamp_ntz")
    return rows(spikes.faulty_readings(s, t, b))


def test_faulty_readings(spark):
    at = pd.Timestamp("2025-01-01").to_pydatetime()
    nan, inf = float("nan"), float("inf")
    normal = [(i, 1, 1, 2 * i, [float(i % 5), float(i % 3), 0.0], [0.01 * (1 + i % 3)] * 3, at, "x", "y") for i in range(60)]
    odd = [
        (100, 1, 1, 1001, None, None, at, None, None), (101, 1, 1, 1003, [nan, 0.0, 0.0], [0.02, 0.02, inf], at, "", ""), (102, 1, 1, 1005, [500.0, 0.0, 0.0], [0.0, 0.1, 0.1], at, "", ""),
        (103, 1, 1, 1007, [0.0, 0.0, 0.0], [0.5, 0.1, 0.1], at, "", ""), (104, 1, 1, 1009, [0.0, 0.0], [0.001] * 3, at, "", ""), (103, 1, 1, 1007, [0.0, 0.0, 0.0], [0.5, 0.1, 0.1], at, "", ""),
    ] + [(200 + i, 1, 2, 10 + i, [1.0, 1.0, 1.0], [0.02, 0.01, 0.01], at, "", "") for i in range(6)]
    path = [v for i in range(8) for v in (i * 0.1, 0.0, 0.0)]
    held = path[:6] + path[6:9] * 5 + path[21:]
    tr = [(i, 1, path, at, 0) for i in range(9)] + [(10, 1, held, at, 0), (11, 1, path[:12], at, 0), (12, 1, None, at, 0), (13, 1, path[:23] + [inf], at, 0), (14, 1, path[:21] + [90.0, 0.0, 0.0], at, 0)]
    bl = [(i, 1, i, 1, -1.0, 2.0 + 0.1 * i, at) for i in range(12)] + [(20, 1, 20, 1, 5.0, 4.0, at), (21, 1, 22, 1, 0.0, 99.0, at), (22, 1, 24, 1, 0.0, 0.1, at), (23, 1, 26, 1, None, None, at)] + [(30 + i, 1, 40 + i, 2, 0.0, 3.0, at) for i in range(4)]
    got = _faulty(spark, normal + odd, tr, bl)
    want = [("chunk_groups", k, "trajectory_max") for k in (20, 21, 22, 30, 31, 32, 33)]
    want += [("splats", 101, "positions"), ("splats", 102, "positions"), ("splats", 101, "scales"), ("splats", 102, "scales"), ("splats", 103, "scales"), ("splats", 104, "scales")] + [("splats", 200 + i, "scales") for i in range(6)]
    want += [("trajectories", k, "positions") for k in (10, 13, 14)]
    assert got == sorted(want, key=repr)
    assert _faulty(spark) == []


def test_best_matching_is_optimal():
    import itertools

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in drift.best_matching(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.permutations(range(m), k))
        assert len(drift.best_matching(c)) == k and got == pytest.approx(best)


def _drift(spark, frames_, heads, lines):
    f = spark.createDataFrame(frames_, "file_id bigint, sequence_id bigint, frame_no int, line string")
    p = spark.createDataFrame(heads, "file_id bigint, ordinal int, prop_name string, prop_type string")
    v = spark.createDataFrame(lines, "file_id bigint, row_no int, line string, type string")
    return drift.Drift(f, p, v)


def test_drift(spark):
    frames_ = [(1, 1, 0, ""), (2, 1, 1, ""), (3, 1, 3, ""), (4, 1, 4, ""), (3, 1, 3, "")]
    heads = [(1, 0, "x", "float"), (1, 1, "a", "uchar"), (1, 2, "gone", "int"), (2, 0, "a2", "uint8"), (2, 1, "x", "float32"), (2, 2, "new", "int"), (3, 0, "a2", None), (3, 1, "x", "double"), (3, 2, "new", "int"), (4, 0, "a2", "int"), (4, 1, "x", "double"), (4, 2, "new", "int"), (4, 2, "new", "int"), (4, 3, None, "int")]
    lines = []
    for r in range(8):
        lines += [(1, r, f" {r * 1.5}  {r * 20}\t{7 - r} \r", ""), (2, r, f"{r * 20} {r * 1.51} {r * r * 40 % 97}", ""), (3, r, f"{r * 20} {r * 1.52} 5", ""), (4, r, f"{r * 20} {r * 1.5e0} 5", ""), (4, r, f"{r * 20} {r * 1.5e0} 5", "")]
    lines += [(1, 9, "odd", ""), (2, None, "1 2 3", ""), (2, 10, None, "")]
    d = _drift(spark, frames_, heads, lines)
    assert rows(d.changes) == sorted([(1, 1, "renamed", "a2"), (1, 1, "removed", "gone"), (1, 1, "added", "new"), (1, 3, "retyped", "x"), (1, 4, "retyped", "a2")], key=repr)
    u = d.unified()
    assert u.columns[:3] == ["sequence_id", "frame_no", "row_no"] and set(u.columns[3:]) == {"a", "gone", "new", "x"} and dict(u.dtypes)["a"] == "bigint" and dict(u.dtypes)["x"] == "double"
    assert {r["a"] for r in u.where("row_no = 3").collect()} == {60}


def test_drift_where_columns_compete(spark):
    """Two new columns carry on from one old one: the nearer is the rename. And a nearest-first choice would leave one old column without
    a partner that both have."""
    frames_ = [(1, 1, 0, ""), (2, 1, 1, ""), (3, 2, 0, ""), (4, 2, 1, "")]
    heads = [(1, 0, "x", "float"), (1, 1, "keep", "int"), (2, 0, "keep", "int"), (2, 1, "far", "float"), (2, 2, "near", "float")]
    heads += [(3, 0, "p", "float"), (3, 1, "q", "float"), (4, 0, "m", "float"), (4, 1, "n", "float")]
    lines = []
    for r in range(40):
        v = r * 7 % 40
        lines += [(1, r, f"{v} 1", ""), (2, r, f"1 {v + 0.9} {v + 0.2}", "")]
        # p is near m and n, q only m
        lines += [(3, r, f"{v} {v - 1.4}", ""), (4, r, f"{v - 0.1} {v + 0.5}", "")]
    d = _drift(spark, frames_, heads, lines)
    assert rows(d.changes) == sorted([(1, 1, "renamed", "near"), (1, 1, "added", "far"), (2, 1, "renamed", "m"), (2, 1, "renamed", "n")], key=repr)
    assert {(r["sequence_id"], r["old"], r["new"]) for r in d.renames.collect()} == {(1, "x", "near"), (2, "p", "n"), (2, "q", "m")}
    assert {(r["property"], r["value"]) for r in d.cells().where("sequence_id = 1 and frame_no = 1 and row_no = 3").collect()} == {("keep", 1.0), ("x", 21.2), ("far", 21.9)}


def test_drift_of_nothing(spark):
    d = _drift(spark, [], [], [])
    assert rows(d.changes) == [] and d.unified().columns == ["sequence_id", "frame_no", "row_no"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-50, 50)] * 3), min_size=1, max_size=200), st.integers(1, 6))
def test_nearest_rows(points, k):
    x = np.array(points)
    _, d = spatial.nearest_rows(x, k)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    want = np.sort(full, 1)[:, :k]
    assert np.allclose(d[:, : want.shape[1]], want)


def test_neighbour_distances_of_a_cut_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 3)) * [30, 1, 1]
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)] + [(2, 9000, 0.0, 0.0, 0.0)], "g int, k bigint, x double, y double, z double")
    whole = dict(spatial.nth_neighbour_distances(df, ["g"], "k", 3).select("k", "distance").collect())
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 100)
    cut = dict(spatial.nth_neighbour_distances(df, ["g"], "k", 3).select("k", "distance").collect())
    assert whole.keys() == cut.keys() and len(cut) == 700 and all(math.isclose(whole[i], cut[i]) for i in cut)


def test_spatial_components(spark):
    pts = [(1, i, i * 0.9, 0.0, 0.0) for i in range(5)] + [(1, 10 + i, 50.0 + i * 0.9, 0.0, 0.0) for i in range(2)] + [(2, 20, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "g int, k bigint, x double, y double, z double")
    assert rows(spatial.components(df, ["g"], "k", 1.0, 3)) == [(i, 0) for i in range(5)]


@settings(max_examples=20, deadline=None)
@given(st.integers(-180, 180), st.integers(-80, 80), st.integers(-180, 180), st.floats(0.1, 5), st.floats(-0.5, 0.5))
def test_transform_parts(a, b, c, s, h):
    t = geometry.Transform((1, 2, 3), (a, b, c), (s, 1.0, 2.0), (h, 0.1, 0.0))
    assert np.allclose(geometry.Transform.of(t.matrix()).matrix(), t.matrix(), atol=1e-6)


def test_quaternions(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    v = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(q, v)], "a double, b double, c double, d double, x double, y double, z double")
    out = df.select(*geometry.quat_rotate([F.col(c) for c in "abcd"], [F.col(c) for c in "xyz"])).collect()
    for (x, y, z, w), p, got in zip(q, v, out):
        m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(m @ p, got, atol=1e-9)
    null = spark.range(1).select(*geometry.quat_normalise([F.lit(0.0)] * 4)).first()
    assert tuple(null) == (0, 0, 0, 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=20))
def test_bits(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    z = bits.zigzag(F.col("v"))
    assert all(a == b and c >= 0 for a, b, c in df.select("v", bits.unzigzag(z), z).collect())
    h = df.select(F.col("v"), bits.mix_u32(F.col("v"))).collect()
    for v, got in h:
        x = (v & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
        x = (x ^ x >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        assert got == x ^ x >> 16


def test_pack_runs(spark):
    got = spark.range(1).select(bits.pack_runs(F.expr("array(1L, 2L, 3L, 7L, 9L, 10L)"))).first()[0]
    assert [tuple(r) for r in got] == [(1, 3), (7, 1), (9, 2)]


def test_fades_and_playback(spark):
    f = spark.range(0, 12).select(timeaxis.weight_at(F.col("id"), F.lit(2), F.lit(8), F.lit(3), F.lit(1))).collect()
    assert [r[0] for r in f] == [0, 0, 0.25, 0.5, 0.75, 1, 1, 1, 0.5, 0, 0, 0]
    m = modifiers.Modifier("colour", {"exposure": 2.0}, start=2, end=8, fade_in=3, fade_out=1)
    assert [m.weight(i) for i in range(12)] == [r[0] for r in f]
    s = spark.range(1).select(*[timeaxis.playback(F.lit(mode), F.lit(e), F.lit(2.0), F.lit(10.0)) for mode, e in (("once", 5.0), ("loop", 2.15), ("loop", -0.1), ("pingpong", 3.0))]).first()
    assert np.allclose(list(s), [2.0, 0.05, 2.0, 1.0])


def test_modifier_stack(spark):
    p = modifiers.Pipeline().add("crop", {"radius": 2.0}).add("loop-morph").add("crop", {"radius": 1.0}).add("walk", {"speed": 2.0}).add("colour", track="b", start=5).add("colour", track="b", start=1)
    assert modifiers.load(modifiers.dump(p)).modifiers == p.modifiers
    above, below = p.split_at_morph()
    assert [m.params.get("radius") for m in above.modifiers if m.kind == "crop"] == [2.0] and [m.params.get("radius") for m in below.modifiers if m.kind == "crop"] == [1.0]
    assert p.walked(3.0, 1.0) == 4.0 and [m.start for m in p.by_track().modifiers[-2:]] == [1, 5]
    assert len(p.remove(0).modifiers) == 5 and p.move(0, 2).modifiers[2].kind == "crop"
    with pytest.raises(ValueError):
        modifiers.Modifier("blur")
    with pytest.raises(ValueError):
        geometry.Transform(scale=(0, 1, 1)).inverse()
    c = spark.createDataFrame([(0.0, 0.5, 0.0), (5.0, 0.5, 0.0)], "x double, y double, z double")
    only_remove = c.where(modifiers.crop_keeps([{"shape": "box", "width": 2, "height": 2, "depth": 2, "remove": True}]))
    assert [r["x"] for r in only_remove.collect()] == [5.0]


def test_ranking(spark):
    df = spark.createDataFrame([(1, i, 0.1 if i in (3, 4, 5) else float(i)) for i in range(20)], "g int, k bigint, s double")
    assert {r["k"] for r in df.join(ranking.prune_budget(df, ["g"], F.col("s"), "k", 10.0, 5.0), ["g", "k"], "left_anti").collect()} == {0, 3}
    for n, limit in ((20, 7), (20, 20), (20, 30), (20, 1)):
        got = {r["k"] for r in ranking.systematic_sample(df, ["g"], "k", limit).collect()}
        assert got == ({i * n // limit for i in range(limit)} if limit < n else set(range(n)))
    t = ranking.transmittance(spark.createDataFrame([(1, 1, 0.0, 0.5), (1, 2, 1.0, 1.0), (1, 3, 2.0, 0.5)], "g int, k int, z double, a double"), ["g"], "z", "k", F.col("a"))
    assert [r["weight"] for r in t.orderBy("k").collect()] == [0.5, 0.5, 0.0]


def test_islands_and_activity(spark):
    df = spark.createDataFrame([(1, i) for i in (1, 2, 3, 7, 9, 10, 10)], "g int, i bigint")
    assert rows(islands.id_runs(df, ["g"], "i")) == [(1, 1, 3), (1, 7, 1), (1, 9, 2)]
    assert rows(islands.first_island(df, ["g"], "i")) == [(1, 1, 3, 3)]
    lives = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 4, 4)], "g int, life_start int, life_end int")
    assert rows(frames.activity(lives, ["g"])) == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 1)]


def test_instants_per_chunk(spark):
    """As by a row per instant, for odd rates and for gaps, overlaps, empty and backward chunks; and without one in a capture of ten thousand million instants."""
    rates = [(1, 30), (1001, 30000), (7, 11), (3, 1), (1, 240), (1, 12)]
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(rates)] + [(9, 1, 1)], "capture_id bigint, time_numerator int, time_denominator int")
    at = [(0, 17), (17, 100), (120, 30), (140, 1), (150, 0), (200, -5), (-3, 9), (201, 99)]
    ch = spark.createDataFrame([(10 * i + j, i, *a) for i in range(len(rates)) for j, a in enumerate(at)] + [(90, 9, 0, 10**9), (91, 9, 10**8, 100)], "chunk_id bigint, capture_id bigint, start_tick bigint, intervals bigint")
    got = {tuple(r) for r in frames.instants_per_chunk(ch, c, 12).collect()}
    assert {r for r in got if r[0] == 9} == {(9, 90, 12 * 10**9 + 1, 0, 10**9), (9, 91, 1200, 12 * 10**8 - 1, 99)}  # a twelfth of a tick is within a billionth there
    k = c.where("capture_id < 9").select("*", F.explode(F.sequence(F.lit(0), F.floor(F.lit(300) * F.col("time_numerator") / F.col("time_denominator") * 12))).alias("k")).withColumn("seconds", F.col("k") / 12.0)
    want = frames.locate_instants(ch, k).groupBy("capture_id", "chunk_id").agg(F.count("*"), F.min("k"), F.max("sample_a"))
    assert {r for r in got if r[0] < 9} == set(map(tuple, want.collect()))


def test_pareto_choice():
    o = {"a": [("raw", 102, 1.0), ("coded", 100, 5.0)], "b": [("raw", 1100, 1.0), ("coded", 1000, 9.0)]}
    assert profile.pareto_choice(o, 0.01) == {"a": "raw", "b": "coded"}


def test_srgb_and_matrix(spark):
    r = spark.range(1).select(colour.linear_to_srgb(colour.srgb_to_linear(F.lit(0.3))), colour.logit(colour.sigmoid(F.lit(1.5)))).first()
    assert np.allclose(list(r), [0.3, 1.5])
    assert np.allclose(colour.colour_matrix(), np.eye(3)) and np.allclose(colour.fold_matrices([]), np.eye(3))


def test_trim_box_of_all_axes(spark):
    from pointtide.operators.ranking import trim_box

    x = np.random.default_rng(1).normal(size=(1000, 3))
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], "g int, k int, x double, y double, z double")
    s = np.sort(x, axis=0)
    want = {i for i, p in enumerate(x) if (p >= s[5]).all() and (p <= s[-6]).all()}
    assert {r["k"] for r in trim_box(df, ["g"]).collect()} == want and len(want) < 990


def test_depth_order_gives_every_record_a_place(spark):
    from pointtide.operators.ranking import depth_order

    z = np.random.default_rng(2).normal(size=500).round(2)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)] + [(2, 900 + i, 1.0) for i in range(3)], "g int, k int, z double")
    for bins in (65536, 16):
        got = {r["k"]: r for r in depth_order(df, ["g"], "z", "k", bins).collect()}
        b = np.floor((z.max() - z) * ((bins - 1) / (z.max() - z.min()))).astype(int)
        assert [got[i]["back"] for i in np.lexsort((np.arange(500), b))] == list(range(500))
        assert [got[i]["front"] for i in np.lexsort((np.arange(500), z))] == list(range(500))
        assert [got[900 + i]["back"] for i in range(3)] == [0, 1, 2]


def _cells(spark):
    rng = np.random.default_rng(3)
    day = pd.Timestamp("2025-01-01")
    high = rng.normal(0.3, 0.05, size=(12, 24)) + np.sin(np.arange(24) / 4) * 0.3
    low = -high
    high[4, 7], low[9, 3], high[2, 2] = 3.5, -2.5, 1.4
    data = [(1, 5, (day + pd.Timedelta(days=d)).date(), h, float(high[d, h]), float(low[d, h])) for d in range(12) for h in range(24)]
    return data, spark.createDataFrame(data + [(1, None, None, 0, 0.1, -9.0)], "field int, source bigint, day date, slot int, high double, low double")


def test_sparse_parts_name_the_cells_that_are_read(spark, monkeypatch):
    data, df = _cells(spark)
    named = {(r["source"], r["day"], r["slot"]) for r in spikes.named_cells(df, 7.0).collect()}
    beyond = {(s, d, h) for _, s, d, h, hi, lo in data if max(hi, -lo) > math.log(7)} | {(None, None, 0)}
    assert beyond <= named and len(named) < len(data) / 3
    least = {tuple(x) for x in spikes._named(df.toPandas(), math.log(7))[["day", "slot"]].itertuples(index=False)}
    monkeypatch.setattr(spikes, "robust_components", lambda m: (m, np.zeros_like(m)))  # no sparse part: only what is beyond the factor
    none = {tuple(x) for x in spikes._named(df.toPandas(), math.log(7))[["day", "slot"]].itertuples(index=False)}
    monkeypatch.setattr(spikes, "robust_components", lambda m: (m * 0, m))  # everything sparse: whatever lies above the median
    every = {tuple(x) for x in spikes._named(df.toPandas(), math.log(7))[["day", "slot"]].itertuples(index=False)}
    assert len(none) < len(least) < len(every) and {(d, h) for _, d, h in beyond} <= {(None if pd.isna(d) else d, h) for d, h in none}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from pointtide.util import ensure_checkpoint_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = lambda master, wanted: SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d: wanted), setCheckpointDir=lambda p: None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    assert ensure_checkpoint_dir(SimpleNamespace(sparkContext=context("spark://host:7077", "/shared"))) == "/shared"
    assert ensure_checkpoint_dir(SimpleNamespace(sparkContext=context("local[4]", None))).endswith("pointtide-checkpoints")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context("spark://host:7077", None)))


def test_poses_between_keys():
    a, b = geometry.Transform((0, 0, 0), (0, 0, 10)), geometry.Transform((2, 0, 4), (0, 0, 90), (3, 1, 1))
    mid = geometry.keyed_transform([(0, a), (10, b)], 2.5)
    assert np.allclose(mid.position, (0.5, 0, 1)) and np.allclose(mid.rotation, (0, 0, 30), atol=1e-6) and np.allclose(mid.scale, (1.5, 1, 1))
    assert geometry.keyed_transform([(0, a), (10, b)], -3) is a and geometry.keyed_transform([(0, a), (10, b)], 99) is b
    rng = np.random.default_rng(2)
    for _ in range(20):
        p, q = (geometry.Transform(rotation=tuple(rng.uniform(-80, 80, 3))) for _ in range(2))
        m = [geometry.mix_transforms(p, q, t).matrix()[:3, :3] for t in (0.0, 0.3, 1.0)]
        angle = lambda r, s: math.acos(max(-1, min(1, (np.trace(r.T @ s) - 1) / 2)))
        assert np.allclose(m[0], p.matrix()[:3, :3]) and np.allclose(m[2], q.matrix()[:3, :3], atol=1e-6)
        assert angle(m[0], m[1]) == pytest.approx(0.3 * angle(m[0], m[2]), abs=1e-6)


def test_every_modifier_of_the_whole_stack_acts(spark, small):
    from pointtide.plans import edits
    from pointtide.plans.base import chunks, splats

    s = splats(spark, small, "x y z qx qy qz qw sx sy sz o r g b").join(chunks(spark, small).select("chunk_id", "intervals"), "chunk_id", "left").persist()
    picks = edits._picks(spark, small).persist()
    result = lambda p: rows(p.run(s, 12.0, picks).select("splat_id", *[F.round(c, 5) for c in ("x", "y", "sx", "o", "r", "g")]))
    whole = result(edits.WHOLE_STACK)
    assert 0 < len(whole) < s.count()
    for i, m in enumerate(edits.WHOLE_STACK.modifiers):
        if m.kind not in ("walk", "audio", "loop-morph"):
            assert result(edits.WHOLE_STACK.remove(i)) != whole, m.kind
    assert edits.WHOLE_STACK.walked(4.0, 2.0) == 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-50, 50)] * 3), min_size=1, max_size=120), st.lists(st.tuples(*[st.floats(-50, 50)] * 3), min_size=1, max_size=120))
def test_nearest_rows_among_others(a, b):
    x, y = np.array(a), np.array(b)
    near, d = spatial.nearest_rows(x, 1, among=y)
    full = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert np.array_equal(d[:, 0], full.min(1)) and np.array_equal(near[:, 0], full.argmin(1))
