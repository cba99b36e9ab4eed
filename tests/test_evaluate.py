import numpy as np
import pytest
from pyspark.sql import functions as F

from pointtide.operators import evaluate as E


def _turn(rng):
    q = rng.normal(size=(1, 4))
    return E._rotations(q / np.linalg.norm(q))[0]


def test_rigid_fit_and_markers():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, r, t = rng.normal(size=(6, 3)), _turn(rng), rng.normal(size=3)
        b = a @ r.T + t
        r2, t2 = E.rigid_fit(a, b)
        assert np.allclose(r, r2) and np.allclose(t, t2) and E.leave_one_out(a, b).max() < 1e-9
        b[2] += 1
        assert E.leave_one_out(a, b)[2] == pytest.approx(3**0.5)


def test_harmonics_turn_with_directions(spark):
    rng = np.random.default_rng(1)
    r, v = _turn(rng), rng.normal(size=(30, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = rng.normal(size=15)
    row = spark.createDataFrame([([float(x) for x in c],)], "c array<double>").select(E.rotate_harmonics(F.col("c"), r), E.rotate_harmonics(F.slice("c", 1, 3), r)).first()
    at = 0
    for band in (1, 2, 3):
        n = 2 * band + 1
        before = E._basis(v, band) @ c[at:at + n]
        assert np.allclose(E._basis(v @ r.T, band) @ np.array(row[0][at:at + n]), before)
        at += n
    assert len(row[1]) == 3


def test_covariance_bake(spark):
    rng = np.random.default_rng(2)
    q, s, m = rng.normal(size=(20, 4)), rng.random((20, 3)) + 0.1, rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(q, s))], "k int, qx double, qy double, qz double, qw double, sx double, sy double, sz double")
    for row in E.covariance_bake(df, m).collect():
        i = row["k"]
        a = m @ (E._rotations((q[i] / np.linalg.norm(q[i]))[None])[0] * s[i])
        b = E._rotations(np.array([[row["qx"], row["qy"], row["qz"], row["qw"]]]))[0] * np.array([row["sx"], row["sy"], row["sz"]])
        assert np.allclose(a @ a.T, b @ b.T)


def test_residual_positions_and_frame(spark):
    rec = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0], [(0, 0.5), (1, 2.0)]), (1, 1, [0.0, 0.0, 0.0], []), (1, 2, [1.0, 1.0, 1.0], [(9, 1.0)])], "chunk_id int, record_id int, base array<double>, terms array<struct<idx:int,weight:double>>")
    dic = spark.createDataFrame([(1, e, s, [float(e + s), 0.0, 1.0]) for e in (0, 1) for s in (0, 1)], "chunk_id int, entry int, sample int, xyz array<double>")
    got = {r["record_id"]: (r["x"], r["y"], r["z"]) for r in E.residual_positions(rec, dic, 0.5, 0).collect()}
    assert got == {0: (1 + 0.25 + 3.0, 2.0, 5.5), 1: (0.0, 0.0, 0.0), 2: (1.0, 1.0, 1.0)}
    f = spark.createDataFrame([(1, 0, 0, 4, 1.0, 0.0, 0.0, [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, -1.0], [0.9, 0.4], 16, [1.0, 0.0, 0.0], [[1.0, 0.0, 0.0]]), (1, 1, 3, 4, 1.0, 0.0, 0.0, [0.0] * 4, [0.0] * 4, [0.0], 0, [0.0] * 3, [])],
                              "chunk_id int, record_id int, life_start int, life_end int, x double, y double, z double, qa array<double>, qb array<double>, opacity_stages array<double>, opacity_code int, colour_base array<double>, colour_stages array<array<double>>")
    m = spark.createDataFrame([(1, [0.0, 0.0, 5.0], [0.0, 0.0, 0.7071067811865476, 0.7071067811865476], 2.0)], "chunk_id int, t array<double>, q array<double>, s double")
    out = E.evaluate_frame(f, m, 0.5, 1, 0.25).collect()
    assert len(out) == 1 and np.allclose([out[0][c] for c in ("x", "y", "z", "o", "r", "g")], [0, 2, 5, 0.5, 1.0, 0.5])
    w = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "g int, i int, v double")
    assert [r["v_sum"] for r in E.cumulative_turns(w, ["g"], "i", ["v"]).orderBy("i").collect()] == [0, 1, 3, 6]


def test_small_ones(spark):
    pal, code = E.median_cut(np.array([[0.0, 0], [0, 1], [9, 0], [9, 1]]), 2)
    assert sorted(map(tuple, pal)) == [(0, 0.5), (9, 0.5)] and code[0] == code[1] != code[2]
    assert len(E.median_cut(np.ones((5, 3)), 4)[0]) == 1
    assert E.greedy_cover(np.array([[1, 0, 0], [0, 1, 0], [0, 1, 0], [1, 0, 1]], bool)) == [1, 0] and E.greedy_cover(np.zeros((2, 3), bool)) == []
    assert E.infer_timebase(1 / 30) == (1, 30) and E.infer_timebase(1001 / 30000) == (1001, 30000) and E.infer_timebase(0.3) == (3, 10)
    with pytest.raises(ValueError):
        E.infer_timebase(0)
    assert E.morph_timing(0.1, 30, 0, 1) == [(31, 0.25), (32, 0.5), (33, 0.75)] and [f for f, _ in E.morph_timing(-0.1, 30, 0, 1)] == [27, 28, 29] and E.morph_timing(-9, 30, 0, 0) == []
    p = spark.createDataFrame([(0.5, 0.5), (2.0, 0.5), (0.5, 3.0)], "x double, y double")
    assert p.where(E.polygon_contains(F.col("x"), F.col("y"), [(0, 0), (1, 0), (1, 1), (0, 1)])).count() == 1


def test_projection_of_harmonics_is_their_rotation_where_the_map_is_one():
    from pointtide.functions.geometry import Transform

    r = Transform(rotation=(20, -35, 70)).matrix()[:3, :3]
    p = E.harmonics_projection(r)
    at = 0
    for band in (1, 2, 3):
        n = 2 * band + 1
        assert np.allclose(p[at : at + n, at : at + n], E.harmonics_rotation(r, band), atol=1e-6)
        at += n
    assert np.allclose(E.harmonics_projection(3.0 * r), p)


def test_rigid_fits_equal_the_fit_of_one_group(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(3):
        a = rng.normal(size=(12, 3)) * 5 + 100 * g
        r, t = E.rigid_fit(a, rng.normal(size=(12, 3)))
        b = a @ r.T + t + rng.normal(size=(12, 3)) * 0.1
        data += [(g, *map(float, p), *map(float, q)) for p, q in zip(a, b)]
    got = {r["g"]: r for r in E.rigid_fits(spark.createDataFrame(data, "g int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double"), ["g"]).collect()}
    for g in range(3):
        x = np.array([d[1:] for d in data if d[0] == g])
        r, t = E.rigid_fit(x[:, :3], x[:, 3:])
        left = np.sqrt((((x[:, :3] @ r.T + t) - x[:, 3:]) ** 2).sum(1).mean())
        assert np.allclose(np.reshape(got[g]["r"], (3, 3)), r) and np.allclose(got[g]["t"], t, atol=1e-6) and abs(got[g]["error"] - left) < 1e-6 and got[g]["rotation"]
