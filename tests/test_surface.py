import numpy as np
from pyspark.sql import functions as F

from pointtide.operators import surface as S


def test_normals_of_a_ball_point_outwards(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(1, i, *map(float, p * 0.4 + [0, 1, 0]), 0.9) for i, p in enumerate(v)], "g int, k int, x double, y double, z double, o double")
    got = np.array([[r["k"], r["nx"], r["ny"], r["nz"]] for r in S.oriented_normals(df, ["g"], "k").collect()])
    facing = np.einsum("ni,ni->n", got[:, 1:], v[got[:, 0].astype(int)])
    assert len(got) == 3000 and (facing > 0.9).mean() > 0.97


def test_contribution_of_a_wall(spark):
    data = [(1, 1, 0.0, 0.0, -1.0, 1.0), (1, 2, 0.0, 0.0, 0.0, 0.5), (1, 3, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g int, k int, x double, y double, z double, o double")
    two = [v for v in S.ring_of_views(4)][::2]  # from the front and from behind
    got = dict(map(tuple, S.contribution_scores(df, ["g"], "k", two).collect()))
    assert got == {1: 0.5, 2: 0.0, 3: 0.5}


def _drawn(x, axes, o, alive, size):
    """The reference's loop, record by record and pixel by pixel."""
    n = alive.sum(1)
    lo, hi = x[n > 0].min(0), x[n > 0].max(0)
    focal, credit = size / 2 / np.tan(np.pi / 8), np.zeros(len(x))
    for eye, r, u, f in S.scoring_views((lo + hi) / 2, np.linalg.norm(hi - lo) / 2):
        for s in range(alive.shape[1]):
            t = np.ones((size, size))
            d = x - eye
            for i in sorted(np.flatnonzero(alive[:, s]), key=lambda i: d[i] @ f):
                a, b, z = d[i] @ r, d[i] @ u, d[i] @ f
                if z < 0.05:
                    continue
                m = np.array([[focal / z, 0, -focal * a / z**2], [0, focal / z, -focal * b / z**2]]) @ np.stack([r, u, f]) @ axes[i]
                cov = m @ m.T + 0.3 * np.eye(2)
                inv, reach, sx, sy = np.linalg.inv(cov), 3 * np.sqrt(max(cov[0, 0], cov[1, 1])), size / 2 + focal * a / z, size / 2 - focal * b / z
                for py in range(max(0, int(sy - reach)), min(size - 1, int(sy + reach)) + 1):
                    for px in range(max(0, int(sx - reach)), min(size - 1, int(sx + reach)) + 1):
                        v = np.array([px + 0.5 - sx, py + 0.5 - sy])
                        alpha = min(0.99, o[i] * np.exp(-0.5 * v @ inv @ v))
                        if t[py, px] >= 1e-4 and alpha >= 1 / 255:
                            credit[i] += alpha * t[py, px]
                            t[py, px] *= 1 - alpha
    return np.where(n > 0, credit / (np.maximum(n, 1) * 24) * (1080 / size) ** 2, -1)


def test_rendered_contributions_equal_a_plain_loop(spark):
    from pointtide.operators.evaluate import _rotations

    rng = np.random.default_rng(3)
    x, q, s, o = rng.normal(size=(12, 3)), rng.normal(size=(12, 4)), rng.uniform(0.05, 0.6, (12, 3)), rng.uniform(0.2, 1, 12)
    life = [(0, 16)] * 6 + [(0, 8)] * 3 + [(8, 16)] * 2 + [(3, 5)]  # the last lives at no instant
    rows = [(1, i, *map(float, [*x[i], *s[i], o[i], *q[i]]), *life[i], 16) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double, z double, sx double, sy double, sz double, o double, qx double, qy double, qz double, qw double, life_start int, life_end int, intervals int")
    got = dict(map(tuple, S.rendered_contributions(df, ["g"], "k", size=24).collect()))
    alive = np.array([[a <= t and b >= t + 1 for t in (2, 6, 10, 14)] for a, b in life])
    want = _drawn(x, _rotations(q / np.linalg.norm(q, axis=1)[:, None]) * s[:, None, :], o, alive, 24)
    assert got[11] == -1 and np.allclose([got[i] for i in range(12)], want, rtol=1e-6)


def test_pictures_are_drawn_in_parts():
    """Whether the pixels of all footprints fit at once or hardly those of one, needles and walls included; and what was drawn before is gone."""
    from pointtide.operators.evaluate import _rotations

    rng = np.random.default_rng(4)
    n, spare = 40, {}
    x, q, o = rng.normal(size=(n, 3)), rng.normal(size=(n, 4)), rng.uniform(0.003, 1, n)
    axes = _rotations(q / np.linalg.norm(q, axis=1)[:, None]) * (10 ** rng.uniform(-3, 0.7, (n, 3)))[:, None, :]
    alive = rng.random((n, 4)) < 0.7
    lived = x[alive.any(1)]
    views = S.scoring_views((lived.min(0) + lived.max(0)) / 2, np.linalg.norm(lived.max(0) - lived.min(0)) / 2)
    want = _drawn(x, axes, o, alive, 16) * np.maximum(alive.sum(1), 1) * 24 / (1080 / 16) ** 2
    for most in (1, 300, 10**6):
        got = S._credits(x, axes, o, alive, views, 16, most, spare)
        assert np.allclose(got[alive.any(1)], want[alive.any(1)], rtol=1e-9) and all((t == 1).all() for t in spare.values())


def test_a_group_is_drawn_in_time():
    """Two chunks of 75 records, 24 views of 256 pixels, at 4 instants: 1.1 s where every view is drawn by itself, 0.2 s where all are drawn at once."""
    import time

    from pointtide.operators.evaluate import _rotations

    rng = np.random.default_rng(6)
    x, q, o, spare = rng.normal(size=(75, 3)), rng.normal(size=(75, 4)), rng.uniform(0.2, 1, 75), {}
    axes = _rotations(q / np.linalg.norm(q, axis=1)[:, None]) * rng.uniform(0.01, 0.08, (75, 3))[:, None, :]
    alive, views = rng.random((75, 4)) < 0.8, S.scoring_views(np.zeros(3), 3.0)
    S._credits(x, axes, o, alive, views, 256, spare=spare)
    began = time.process_time()
    for _ in range(2):
        S._credits(x, axes, o, alive, views, 256, spare=spare)
    assert time.process_time() - began < 0.6


def test_wide_footprints_are_drawn_whole(monkeypatch):
    """Rectangles among small footprints, before and behind them, in two chunks at once."""
    from pointtide.operators.evaluate import _rotations

    rng = np.random.default_rng(11)
    x, q, o = rng.normal(size=(40, 3)), rng.normal(size=(40, 4)), rng.uniform(0.003, 1, 40)
    axes = _rotations(q / np.linalg.norm(q, axis=1)[:, None]) * (10 ** rng.uniform(-2, 0.7, (40, 3)))[:, None, :]
    alive, chunk = rng.random((40, 4)) < 0.7, np.repeat([0, 1], 20)
    ends = [(x[(chunk == c) & alive.any(1)].min(0), x[(chunk == c) & alive.any(1)].max(0)) for c in (0, 1)]
    views = [S.scoring_views((lo + hi) / 2, np.linalg.norm(hi - lo) / 2) for lo, hi in ends]
    eyes, turns = np.stack([[v[0] for v in c] for c in views], 1), np.stack([np.stack(v[1:]) for v in views[0]])
    want = np.concatenate([_drawn(x[chunk == c], axes[chunk == c], o[chunk == c], alive[chunk == c], 16) for c in (0, 1)]) * np.maximum(alive.sum(1), 1) * 24 / (1080 / 16) ** 2
    for wide, most in ((30, 10**6), (200, 10**6), (30, 500), (1, 10**6)):
        monkeypatch.setattr(S, "WIDE", wide)
        got = S._drawn(x, axes, o, alive, chunk, eyes, turns, 16, most)
        assert np.allclose(got[alive.any(1)], want[alive.any(1)], rtol=1e-9)


def test_a_needle_keeps_its_width():
    """A record of one axis of 3e38, whose determinant as a difference of products is rounding alone."""
    from fractions import Fraction

    axes = np.array([[[2e38, 0.02, 0.01], [1e38, 0.03, -0.05], [2e38, -0.04, 0.02]]])
    foot = S._footprints(np.zeros((1, 3)), axes, np.ones(1), np.zeros(1, int), np.array([[[0.0, 0.0, -4.0]]]), np.eye(3)[None], 64)[2][:, 0]
    f = Fraction(64 / 2 / np.tan(np.pi / 8)) / 4
    u, v = ([f * Fraction(float(c)) for c in axes[0, k]] for k in (0, 1))
    xx, xy, yy = sum(c * c for c in u) + Fraction(0.3), sum(c * d for c, d in zip(u, v)), sum(c * c for c in v) + Fraction(0.3)
    det = xx * yy - xy * xy
    assert np.allclose(foot[2:6], [float(c) for c in (yy / det, -xy / det, xx / det, det)], rtol=1e-9, atol=0)


def test_groups_are_scored_across_batches(spark):
    """Groups that end within a batch, at its end and beyond it, one of them without a name, score as they do alone."""
    rng = np.random.default_rng(12)
    rows = [(g, i, *map(float, [*rng.normal(size=3), *rng.uniform(0.05, 0.3, 3), rng.uniform(0.2, 1)])) for g, n in ((None, 3), (1, 7), (2, 25), (3, 1), (4, 14)) for i in range(1000 * (g or 0), 1000 * (g or 0) + n)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double, z double, sx double, sy double, sz double, o double").coalesce(1)
    alone = [r for g in (None, 1, 2, 3, 4) for r in S.rendered_contributions(df.where(F.col("g").eqNullSafe(g)), ["g"], "k", size=24).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = dict(map(tuple, S.rendered_contributions(df, ["g"], "k", size=24).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 50 and all(np.isclose(got[k], v) for k, v in alone)


def test_a_stack_bakes_what_its_crops_leave(spark, monkeypatch):
    from pointtide.operators import modifiers as M

    baked, bake = [], M.covariance_bake
    monkeypatch.setattr(M, "covariance_bake", lambda df, m: baked.append(df.count()) or bake(df, m))
    rows = [(1, i, i, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.1, 0.2, 0.3, 0.5, 0.5, 0.5, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id int, record_id int, splat_id int, x double, y double, z double, qx double, qy double, qz double, qw double, sx double, sy double, sz double, o double, r double, g double, b double")
    p = M.Pipeline().add("animate-transform", {"keys": [{"frame": 0, "offset": (1, 0, 0), "rotation": (0, 0, 90)}]}).add("crop", {"shape": "box", "width": 4.0, "height": 10.0, "depth": 2.0})
    kept = p.run(df, 0.0)
    assert kept.count() == baked[0] < 40 and all(r["sx"] == np.float64(0.3) or abs(r["sx"] - 0.3) < 1e-9 for r in kept.collect())


def test_prune_by_contribution(spark):
    """A large record that others hide goes first, not the small one that is seen."""
    from pointtide.operators.modifiers import Pipeline

    rng = np.random.default_rng(5)
    v = rng.normal(size=(320, 3))
    shell = 2 * v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(1, i, i, *map(float, p), 0.5, 0.5, 0.5, 1.0, 0.5, 0.5, 0.5) for i, p in enumerate(shell)]
    rows += [(1, 1000, 1000, 0.0, 0.0, 0.0, 0.8, 0.8, 0.8, 1.0, 0.5, 0.5, 0.5), (1, 1001, 1001, 0.0, 4.0, 0.0, 0.05, 0.05, 0.05, 1.0, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "chunk_id int, record_id int, splat_id int, x double, y double, z double, sx double, sy double, sz double, o double, r double, g double, b double")
    kept = Pipeline().add("prune-low-contribution", {"percent": 0.4}).run(df, 0.0)
    assert {r[0] for r in df.select("splat_id").exceptAll(kept.select("splat_id")).collect()} == {1000}


def test_a_stack_draws_each_chunk_once(spark, tmp_path, monkeypatch):
    from pointtide.operators import modifiers as M

    log = str(tmp_path / "drawn")

    def noted(df, groups, key):
        def scores(t):
            with open(log, "a") as f:
                f.write("drawn\n")
            return t.select(["splat_id"]).append_column("score", t.column("o"))

        return df.select(*groups, key, "o").groupBy(*groups).applyInArrow(scores, "splat_id int, score double")

    monkeypatch.setattr(M, "rendered_contributions", noted)
    rows = [(c, i, 100 * c + i, float(i), 0.0, 0.0, 0.1, 0.1, 0.1, i / 40, 0.5, 0.5, 0.5) for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id int, record_id int, splat_id int, x double, y double, z double, sx double, sy double, sz double, o double, r double, g double, b double")
    out = M.Pipeline().add("prune-low-contribution", {"percent": 10.0}).add("prune-low-contribution", {"percent": 5.0}).add("purge-isolated", {"neighbour": 2}).run(df, 0.0)
    assert out.count() == 3 * (40 - 4 - 1) and open(log).read().count("drawn") == 3


def test_recovered_colour_never_passes_the_source(spark):
    rng = np.random.default_rng(8)
    data = [(1, i, *map(float, rng.random(3) * [0.2, 0.2, 0.01]), 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4) for i in range(400)] + [(1, 900, 0.1, 0.1, 0.005, 0.9, 0.5, 0.5, 0.4, 0.56, 0.5, 0.4), (1, 901, 5.0, 5.0, 5.0, 0.9, 0.5, 0.5, 0.4, 0.56, 0.5, 0.4)]
    df = spark.createDataFrame(data, "g int, k int, x double, y double, z double, o double, r double, g_ double, b double, r0 double, g0 double, b0 double").withColumnRenamed("g", "chunk").withColumnRenamed("g_", "g")
    got = {r["k"]: r for r in S.recover_colour(df, ["chunk"], "k", F.col("k") < 900, F.col("k") >= 900).collect()}
    assert set(got) == {900} and 0 < got[900]["dr"] <= 0.95 * 0.06 + 1e-9 and got[900]["dg"] == 0


def test_recovered_colour_takes_any_finite_position(spark):
    far = [(1e25, 0.0, 0.0), (-3.4e38, 0.1, 3.4e38), (4e17, -4e17, 0.0)]
    rng = np.random.default_rng(9)
    data = [(1, i, *map(float, rng.random(3) * [0.2, 0.2, 0.01]), 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4) for i in range(400)]
    data += [(1, 900 + i, *p, 0.9, 0.5, 0.5, 0.4, 0.56, 0.5, 0.4) for i, p in enumerate([(0.1, 0.1, 0.005), *far])] + [(1, 500 + i, *p, 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4) for i, p in enumerate(far)]
    df = spark.createDataFrame(data, "chunk int, k int, x double, y double, z double, o double, r double, g double, b double, r0 double, g0 double, b0 double")
    assert {r["k"] for r in S.recover_colour(df, ["chunk"], "k", F.col("k") < 900, F.col("k") >= 900).collect()} == {900}


def test_recovered_colour_equals_a_plain_loop(spark):
    """Two surfaces, one of them where the grid ends, and a patch too small to lead."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.random((300, 3)) * [0.2, 0.2, 0.01], rng.random((20, 3)) * 0.01 + 3, np.tile([1e18, 0, 0], (300, 1)) + rng.random((300, 3)) * [0, 0.2, 0.01]])
    c, o, n = np.tile([0.6, 0.45, 0.4], (620, 1)) * rng.uniform(0.8, 1.1, (620, 1)), rng.uniform(0.2, 1, 620), 40
    y, now, was = np.concatenate([x[:n], x[300:310], x[-n:]]) + [0, 0.004, 0], np.tile([0.5, 0.5, 0.4], (90, 1)), np.tile([0.56, 0.45, 0.4], (90, 1))
    rows = [(1, i, *map(float, [*x[i], o[i], *c[i], *c[i]])) for i in range(620)] + [(1, 1000 + i, *map(float, [*y[i], 0.9, *now[i], *was[i]])) for i in range(90)]
    df = spark.createDataFrame(rows, "chunk int, k int, x double, y double, z double, o double, r double, g double, b double, r0 double, g0 double, b0 double")
    got = {r["k"]: [r["dr"], r["dg"], r["db"]] for r in S.recover_colour(df, ["chunk"], "k", F.col("k") < 1000, F.col("k") >= 1000).collect()}
    ref, light, want = np.r_[0:300, 320:620], np.array([0.2126, 0.7152, 0.0722]), {}
    for i in range(90):
        q = ((x[ref] - y[i]) ** 2).sum(1)
        near = np.argsort(q)[:16]
        near = near[q[near] < 0.055**2]
        if len(near) < 8 or q[near[7]] >= 0.05**2:
            continue
        w = o[ref[near]] / np.maximum(q[near], 0.002**2)
        shift = np.clip((w[:, None] * c[ref[near]] / (c[ref[near]] @ light)[:, None]).sum(0) / w.sum() * (now[i] @ light) - now[i], -0.2, 0.2)
        want[1000 + i] = 0.95 * np.clip(shift, np.minimum(was[i] - now[i], 0), np.maximum(was[i] - now[i], 0))
    assert set(got) == set(want) and len(want) > 60 and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_recovered_colour_ties_go_by_key(spark):
    """Of 24 references equally far on either side, or at one place, the 16 of the smallest keys lead."""
    line = [(1, 100 + i, 0.01 * i + 0.5, 0.0, 0.0, 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4) for i in range(300)]
    near = [(1, i, -0.0078125 if i % 3 else 0.0078125, 0.0, 0.0, 0.9, 0.5 + 0.01 * i, 0.45, 0.4, 0.6, 0.45, 0.4) for i in range(24)]
    step = [(1, 50 + i, 0.015 * (i + 4), 0.0, 0.0, 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4) for i in range(30)] + [(1, 99, 0.0275, 0.055, 0.0, 0.9, 0.6, 0.45, 0.4, 0.6, 0.45, 0.4)]
    own = (1, 900, 0.0, 0.0, 0.0, 0.9, 0.5, 0.5, 0.4, 1.0, 0.0, 0.0)
    df = spark.createDataFrame([*line, *near[::-1], *step, own], "chunk int, k int, x double, y double, z double, o double, r double, g double, b double, r0 double, g0 double, b0 double")
    (got,) = S.recover_colour(df, ["chunk"], "k", F.col("k") < 900, F.col("k") >= 900, link=0.06).collect()
    light, c = np.array([0.2126, 0.7152, 0.0722]), np.array([near[i][6:9] for i in range(16)])
    want = 0.95 * ((c / (c @ light)[:, None]).mean(0) * ([0.5, 0.5, 0.4] @ light) - [0.5, 0.5, 0.4])
    assert np.allclose(got["dr"], want[0], atol=1e-12) and np.allclose(got["dg"], want[1], atol=1e-12)


def test_recovered_colour_passes_over_seeds_without_luminance(spark):
    data = [(1, i, 0.01 * i, 0.0, 0.0, 0.9, *c, *c) for i in range(300) for c in [(0.0, 0.0, 0.0) if i % 5 == 0 else (0.6, 0.45, 0.4)]]
    df = spark.createDataFrame([*data, (1, 900, 1.0, 0.001, 0.0, 0.9, 0.5, 0.5, 0.4, 0.56, 0.45, 0.4)], "chunk int, k int, x double, y double, z double, o double, r double, g double, b double, r0 double, g0 double, b0 double")
    (got,) = S.recover_colour(df, ["chunk"], "k", F.col("k") < 900, F.col("k") >= 900).collect()
    assert np.isclose(got["dr"], 0.95 * 0.06) and np.isclose(got["dg"], 0.95 * (0.45 * 0.49252 / (0.6 * 0.2126 + 0.45 * 0.7152 + 0.4 * 0.0722) - 0.5), atol=1e-3)


def test_partners(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "g int, k int, x double, y double, z double, r double, g2 double, b double")
    b = spark.createDataFrame([(1, 5, 0.01, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 6, 0.02, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 7, 0.02, 0.0, 0.0, 1.0, 0.0, 0.0)], a.schema)
    name = lambda d: d.withColumnRenamed("g", "grp").withColumnRenamed("g2", "g")
    assert [(r["k"], r["partner"]) for r in S.likest_partner(name(a), name(b), ["grp"], "k").collect()] == [(1, 6)]
