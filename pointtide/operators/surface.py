"""Surfaces: what each record contributes to views, which way it faces, colour recovered from its surroundings, likest partners."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import transmittance
from .spatial import components, nearest_rows

__all__ = ["ring_of_views", "contribution_scores", "scoring_views", "rendered_contributions", "oriented_normals", "recover_colour", "likest_partner"]


def ring_of_views(n: int = 8, heights: tuple[float, ...] = (0.0,)) -> list[tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]]:
    """(right, up, forward) of cameras that look inwards from a ring at each height."""
    out = []
    for h in heights:
        for k in range(n):
            a = 2 * math.pi * k / n
            f = np.array([-math.sin(a), -h, -math.cos(a)])
            f /= np.linalg.norm(f)
            r = np.cross(f, [0.0, 1.0, 0.0])
            r /= np.linalg.norm(r)
            out.append((tuple(map(float, r)), tuple(map(float, np.cross(r, f))), tuple(map(float, f))))
    return out


def _dot(v, x: Column, y: Column, z: Column) -> Column:
    return x * float(v[0]) + y * float(v[1]) + z * float(v[2])


def contribution_scores(df: DataFrame, groups: list[str], key: str, views: list, pixels: int = 64) -> DataFrame:
    """(key, score): mean over the views of opacity times what the records in front let through, each record in the pixel of its
    centre, seen without perspective. The views are few and go into the plan as literals; the pixel is the unit of the ordering, so
    that its rows, not the chunk's, share a task."""
    span = F.greatest(*[F.max(a) - F.min(a) for a in "xyz"])
    box = df.groupBy(*groups).agg(*[((F.max(a) + F.min(a)) / 2).alias(f"_c{a}") for a in "xyz"], F.greatest(span, F.lit(1e-9)).alias("_span"))
    d = df.select(*groups, key, "o", "x", "y", "z").join(box, groups)
    rel = [F.col(a) - F.col(f"_c{a}") for a in "xyz"]
    seen = F.array(*[F.struct(F.lit(i).alias("v"), F.floor((_dot(r, *rel) / F.col("_span") + 0.9) * pixels).cast("int").alias("px"), F.floor((_dot(u, *rel) / F.col("_span") + 0.9) * pixels).cast("int").alias("py"), _dot(f, *rel).alias("depth")) for i, (r, u, f) in enumerate(views)])
    rays = d.select(*groups, key, "o", F.explode(seen).alias("s")).select(*groups, key, "o", "s.v", "s.px", "s.py", "s.depth")
    t = transmittance(rays, [*groups, "v", "px", "py"], "depth", key, F.col("o"))
    return t.groupBy(key).agg((F.sum("weight") / len(views)).alias("score"))


@lru_cache(maxsize=1)
def _unit_views() -> tuple[np.ndarray, np.ndarray]:
    """(eyes, turns) of 24 cameras of 45 degrees around the unit ball: 8 far, 8 near, 4 from above and 4 from below; the rows of a turn
    are right, up and forward."""
    far = 1 / math.tan(math.radians(22.5)) * 1.05
    near, eyes, turns = far * 0.45, [], []
    for k in range(8):
        for a, r, h in ((k * math.pi / 4, far, 0.3), (k * math.pi / 4 + math.pi / 8, near, 0.1)):
            eyes.append((math.sin(a) * r, h, math.cos(a) * r))
    for k in range(4):
        a = (k + 0.5) * math.pi / 2
        eyes += [(math.sin(a) * 0.35 * far, h * far, math.cos(a) * 0.35 * far) for h in (0.95, -0.95)]
    for e in np.array(eyes):
        f = -e / np.linalg.norm(e)
        r = np.cross(f, [0.0, 0.0, 1.0] if abs(f[1]) > 0.99 else [0.0, 1.0, 0.0])
        r /= np.linalg.norm(r)
        turns.append((r, np.cross(r, f), f))
    return np.array(eyes), np.array(turns)


def scoring_views(centre: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(eye, right, up, forward) of 24 cameras of 45 degrees around a ball: 8 far, 8 near, 4 from above and 4 from below."""
    eyes, turns = _unit_views()
    return [(centre + radius * e, *t) for e, t in zip(eyes, turns)]


def _footprints(x: np.ndarray, axes: np.ndarray, o: np.ndarray, chunk: np.ndarray, eyes: np.ndarray, turns: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, row, footprint: centre, inverse covariance, its determinant and pixel bounds, a row each) of the records that the views see,
    group by group, each front to back. ``eyes`` has a view's eye per chunk; a chunk's view is a group, numbered view by view."""
    focal, n = size / 2 / math.tan(math.radians(22.5)), len(x)
    x, e, t = np.ascontiguousarray(x.T), eyes.transpose(2, 0, 1)[:, :, chunk], turns.transpose(1, 2, 0)[..., None]
    axes = np.ascontiguousarray(axes.transpose(1, 2, 0))
    with np.errstate(all="ignore"):
        d = [x[i] - e[i] for i in range(3)]
        p = [d[0] * t[k, 0] + d[1] * t[k, 1] + d[2] * t[k, 2] for k in range(3)]
        view, at = np.nonzero((p[2] >= 0.05) & (o >= 1 / 255))
        by = view * n + at
        a, b, z = (c.ravel()[by] for c in p)
        m = [[t[k, 0] * axes[0, j] + t[k, 1] * axes[1, j] + t[k, 2] * axes[2, j] for j in range(3)] for k in range(3)]
        scale, a, b = focal / z, a / z, b / z
        u, v = ([scale * (m[k][j].ravel()[by] - c * m[2][j].ravel()[by]) for j in range(3)] for k, c in ((0, a), (1, b)))
        uu, vv, xy = (f[0] * g[0] + f[1] * g[1] + f[2] * g[2] for f, g in ((u, u), (v, v), (u, v)))
        xx, yy = uu + 0.3, vv + 0.3  # the low-pass of 0.3 pixels
        # xx * yy - xy * xy, of which nothing is left where one axis is by far the longest
        det = sum((u[i] * v[j] - u[j] * v[i]) ** 2 for i, j in ((0, 1), (0, 2), (1, 2))) + 0.3 * (uu + vv) + 0.09
        sx, sy, reach = size / 2 + focal * a, size / 2 - focal * b, 3 * np.sqrt(np.maximum(xx, yy))
        whole = lambda c: np.trunc(np.clip(c, -1e6, 1e6))
        x0, x1 = np.maximum(0, whole(sx - reach)), np.minimum(size - 1, whole(sx + reach))
        y0, y1 = np.maximum(0, whole(sy - reach)), np.minimum(size - 1, whole(sy + reach))
        ok = np.flatnonzero((det > 0) & (x0 <= x1) & (y0 <= y1))
        group = view * eyes.shape[1] + chunk[at]
        ok = ok[np.lexsort((z[ok], group[ok]))]
        foot = np.stack([c[ok] for c in (sx, sy, yy / det, -xy / det, xx / det, det, x0, x1, y0, y1)])
    return group[ok], at[ok], foot


def _pixels(group: np.ndarray, foot: np.ndarray, o: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, pixel of its group's picture, alpha) of the pixels in which a footprint has an alpha of 1/255 or more, item by item. A line of
    a footprint is drawn where its ellipse crosses it, a little wider on both sides; one too thin to say where, over its whole width."""
    sx, sy, a, b, c, det, x0, x1, y0, y1 = foot
    rows = (y1 - y0 + 1).astype(np.int64)
    item = np.repeat(np.arange(len(rows)), rows)
    py = np.arange(len(item)) + np.repeat(y0.astype(np.int64) - (np.cumsum(rows) - rows), rows)
    dy = py + 0.5 - sy[item]
    most = np.log(255 * o)  # an alpha of 1/255 lies so far down
    with np.errstate(all="ignore"):
        half = np.sqrt(np.maximum((2 * a * most)[item] - dy * dy / det[item], 0)) / a[item]
        mid = (sx - 0.5)[item] - (b / a)[item] * dy
        sure = (a * c * det < 1e8)[item]
        left = np.where(sure & np.isfinite(mid - half), np.maximum(x0[item], np.ceil(mid - half - 0.01)), x0[item]).astype(np.int64)
        right = np.where(sure & np.isfinite(mid + half), np.minimum(x1[item], np.floor(mid + half + 0.01)), x1[item]).astype(np.int64)
    n = np.maximum(right - left + 1, 0)
    line = np.repeat(np.arange(len(item)), n)
    px = (left - (np.cumsum(n) - n)).take(line)
    px += np.arange(len(line))
    dx = px - (sx - 0.5)[item].take(line)
    q = (a / 2)[item].take(line)
    q *= dx
    q += (b[item] * dy).take(line)
    q *= dx
    q += ((c / 2)[item] * dy * dy).take(line)
    over = most[item].take(line)
    over -= q
    px += (group[item] * (size * size) + py * size).take(line)
    ok = (q >= 0) & (over >= 0)
    if not ok.all():
        px, over, line = px[ok], over[ok], line[ok]
    alpha = np.exp(over, out=over)
    alpha /= 255
    return item.take(line), px, np.minimum(alpha, 0.99, out=alpha)


def _blend(pixel: np.ndarray, alpha: np.ndarray, item: np.ndarray, lit: np.ndarray, picture: np.ndarray | None = None) -> np.ndarray:
    """Each item's alphas times what is let through to them, front to back within a pixel, summed over its pixels and the instants at which
    it lives (rows of ``lit``). Pixels that are hit once need no more than a sort; of the others the second hits are taken at once, then the
    third ones, and so on. ``picture``, where given, has what earlier hits let through, and is carried on."""
    bits = len(pixel).bit_length()
    key = pixel << bits
    key |= np.arange(len(pixel))
    key.sort()
    spot = key >> bits
    start = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]][: len(key)])
    count = np.diff(start, append=len(key))
    lives = lit.sum(1)
    if picture is None:
        credit = np.bincount(item, alpha, len(lit)) * lives
        start, count = start[count > 1], count[count > 1]
        through = np.ones((len(start), lit.shape[1]))
    else:
        credit = np.zeros(len(lit))
        through = picture.take(spot[start], 0)
    deep = np.argsort(-count, kind="stable")
    start, count, through = start[deep], -count[deep], through.take(deep, 0)
    for layer in range(-int(count[0]) if len(count) else 0):
        n = int(np.searchsorted(count, -layer))  # the pixels with more hits than these
        hit, seen = key[start[:n] + layer] & ((1 << bits) - 1), through[:n]
        k, a = item.take(hit), alpha.take(hit)
        now = lit.take(k, 0)
        if picture is not None:
            credit += np.bincount(k, a * np.einsum("ns,ns->n", now, seen * (seen >= 1e-4)), len(lit))
        elif layer:
            credit += np.bincount(k, a * (np.einsum("ns,ns->n", now, seen * (seen >= 1e-4)) - lives.take(k)), len(lit))
        now *= -a[:, None]
        now += 1
        seen *= now
    if picture is not None:
        picture[spot[start]] = through
    return credit


def _sheets(foot: np.ndarray, o: np.ndarray, lit: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(credit, pixels, alphas) of the wide footprints of one view, front to back: what they earn where nothing else is drawn, and their
    pixels and alphas where ``taken``, the picture of the other footprints, is set."""
    credit, pixels, alphas, size = np.zeros(foot.shape[1]), [], [], len(taken)
    through = np.ones((lit.shape[1], size, size)) if foot.shape[1] > 1 else None
    for i, (sx, sy, a, b, c, _, *box) in enumerate(foot.T):
        x0, x1, y0, y1 = map(int, box)
        here = (slice(y0, y1 + 1), slice(x0, x1 + 1))
        dx, dy = np.arange(x0, x1 + 1) + 0.5 - sx, np.arange(y0, y1 + 1) + 0.5 - sy
        q = a / 2 * dx + (b * dy)[:, None]
        q *= dx
        q += (c / 2 * dy * dy)[:, None]
        alpha = np.log(255 * o[i]) - q
        ok = (q >= 0) & (alpha >= 0)
        np.exp(alpha, out=alpha, where=ok)
        alpha /= 255
        np.minimum(alpha, 0.99, out=alpha)
        alpha *= ok
        y, x = np.nonzero(taken[here] & ok)
        pixels.append((y + y0) * size + x + x0)
        alphas.append(alpha[y, x])
        alpha[y, x] = 0
        if through is None:
            credit[i] = alpha.sum() * lit[i].sum()
            continue
        left = 1 - alpha
        for s in np.flatnonzero(lit[i]):
            seen = through[s][here]
            credit[i] += np.einsum("yx,yx,yx->", alpha, seen, seen >= 1e-4)
            seen *= left
    return credit, pixels, alphas


#: Pixels from which a footprint is drawn as a whole rectangle.
WIDE = 1500


def _drawn(x: np.ndarray, axes: np.ndarray, o: np.ndarray, alive: np.ndarray, chunk: np.ndarray, eyes: np.ndarray, turns: np.ndarray, size: int, most: int = 200_000, spare: dict | None = None) -> np.ndarray:
    """Each record's blending weight, summed over the pixels of its chunk's views at all instants (columns of ``alive``). Whole views are
    drawn side by side, up to ``most`` pixels of footprints at a time, of wide ones only what others meet; a view of more is drawn in parts,
    over one picture. ``spare`` keeps that picture for the next call, which finds it clear."""
    group, row, foot = _footprints(x, axes, np.where(alive.any(1), o, 0), chunk, eyes, turns, size)
    lit, o, credit = alive.astype(float)[row], o[row], np.zeros(len(row))
    spare, shape = {} if spare is None else spare, (size * size, alive.shape[1])
    box = (foot[7] - foot[6] + 1) * (foot[9] - foot[8] + 1)
    wide = box >= WIDE
    small = np.bincount(group, np.where(wide, 0, box), group[-1] + 1 if len(group) else 0)
    upto = np.cumsum(np.where(wide, np.minimum(box, small[group]), box))
    lo, begun = 0, False
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        picture = None
        if begun or (hi < len(row) and group[hi] == group[hi - 1]):
            first, end = (int(np.searchsorted(group, group[g], side)) for g, side in ((min(hi, len(row) - 1), "left"), (lo, "right")))
            if not begun and first > lo:
                hi = first
            else:
                hi = min(hi, end)
                picture = spare[shape] = spare[shape] if shape in spare else np.ones(shape)
        thin = np.arange(lo, hi) if picture is not None else lo + np.flatnonzero(~wide[lo:hi])
        item, pixel, alpha = _pixels(group[thin] - group[lo], foot[:, thin], o[thin], size)
        item = thin[item] - lo
        if len(thin) < hi - lo:
            items, pixels, alphas = [item], [pixel], [alpha]
            broad = lo + np.flatnonzero(wide[lo:hi])
            of, begin = np.unique(group[broad], return_index=True)
            cut = np.searchsorted(pixel // (size * size), [of - group[lo], of - group[lo] + 1])
            for g, w, i, j in zip(of.tolist(), np.split(broad, begin[1:]), *cut.tolist()):
                base = (g - group[lo]) * (size * size)
                taken = np.zeros(size * size, bool)
                taken[pixel[i:j] - base] = True
                credit[w], at, a = _sheets(foot[:, w], o[w], lit[w], taken.reshape(size, size))
                items.append(np.repeat(w - lo, [len(p) for p in at]))
                pixels += [p + base for p in at]
                alphas += a
            item, pixel, alpha = map(np.concatenate, (items, pixels, alphas))
            by = np.argsort(item, kind="stable")
            item, pixel, alpha = item[by], pixel[by], alpha[by]
        credit[lo:hi] += _blend(pixel, alpha, item, lit[lo:hi], picture)
        if picture is not None:
            begun = hi < end
            if not begun:
                picture[:] = 1
        lo = hi
    return np.bincount(row, credit, len(x))


def _credits(x: np.ndarray, axes: np.ndarray, o: np.ndarray, alive: np.ndarray, views: list, size: int, most: int = 200_000, spare: dict | None = None) -> np.ndarray:
    """The weights of one chunk's records in the given views."""
    return _drawn(x, axes, o, alive, np.zeros(len(x), np.int64), np.stack([v[0] for v in views])[:, None], np.stack([np.stack(v[1:]) for v in views]), size, most, spare)


def _scores(t: pa.Table, start: np.ndarray, size: int, instants: int, spare: dict) -> np.ndarray:
    """The scores of whole groups, which begin at ``start``."""
    from .evaluate import _rotations

    get = lambda *names: np.stack([t.column(c).to_numpy() for c in names], 1)
    x, q, o = get("x", "y", "z"), get("qx", "qy", "qz", "qw"), get("o")[:, 0]
    chunk = np.repeat(np.arange(len(start)), np.diff(start, append=len(x)))
    life, length = get("life_start", "life_end"), np.maximum(np.maximum.reduceat(np.nan_to_num(get("intervals")[:, 0].astype(float)), start), 0)
    length = np.where(length == 0, np.maximum.reduceat(life[:, 1], start), length)
    at = np.floor((np.arange(instants) + 0.5) / instants * length[:, None])[chunk]
    alive = (life[:, :1] <= at) & (life[:, 1:] >= at + 1)
    n = alive.sum(1)
    lo, hi = (f.reduceat(np.where(n[:, None] > 0, x, far), start) for f, far in ((np.minimum, np.inf), (np.maximum, -np.inf)))
    unit, turns = _unit_views()
    with np.errstate(all="ignore"):  # a group of which nothing lives has no views
        eyes = (lo + hi) / 2 + np.maximum(np.linalg.norm(hi - lo, axis=1) / 2, 1e-3)[:, None] * unit[:, None]
    norm = np.linalg.norm(q, axis=1)
    turned = norm > 1e-12  # what has no orientation isn't drawn
    axes = _rotations(q / np.where(turned, norm, 1)[:, None]) * get("sx", "sy", "sz")[:, None, :]
    credit = _drawn(x, axes, np.where(turned, o, 0), alive, chunk, eyes, turns, size, spare=spare)
    return np.where(n > 0, credit / (np.maximum(n, 1) * len(turns)) * (1080 / size) ** 2, -1.0)


#: Records that are drawn together, but that a group of more is drawn whole.
DRAWN_ROWS = 500


def rendered_contributions(df: DataFrame, groups: list[str], key: str, size: int = 256, instants: int = 4) -> DataFrame:
    """(key, score): what each record of a group contributes, in pixels of a view of 1080 lines: its blending weight under its projected
    Gaussian footprint, summed over the pixels of 24 views at mid-interval instants and divided by the views and the instants at
    which it lives; -1 where it lives at none.

    ``df`` has x, y, z, sx, sy, sz and o; qx to qw (else unturned); life_start and life_end (else always alive) with ``intervals``, the
    length of the group (else up to its last life_end). A group is one chunk's records, which the format bounds; small ones are drawn
    several at a time, as they come along in a sorted partition."""
    has = set(df.columns)
    num = lambda c, v: (F.col(c).cast("double") if c in has else F.lit(float(v)) if v is not None else F.lit(None).cast("double")).alias(c)
    cols = [*((a, 0) for a in ("x", "y", "z", "sx", "sy", "sz", "o", "qx", "qy", "qz")), ("qw", 1), ("life_start", -1e18), ("life_end", 1e18), ("intervals", None)]
    # records of equal depth are drawn in the order of their keys; a group begins at its first
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(key)) == 1
    rows = df.select(F.col(key).alias("key"), *[num(*c) for c in cols], first.alias("first"))
    kind, spare = dict(rows.dtypes)["key"], {}

    def drawn(t: pa.Table, start: np.ndarray):
        end, at = np.r_[start[1:], t.num_rows], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + DRAWN_ROWS, side="right")))
            part = t.slice(start[at], end[to - 1] - start[at])
            yield from pa.table({"key": part.column("key"), "score": _scores(part, start[at:to] - start[at], size, instants, spare)}).to_batches()
            at = to

    def scores(batches):
        held = []  # the last group so far, which may go on
        for batch in batches:
            start = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            if len(start):
                t = pa.Table.from_batches([*held, batch]).combine_chunks()
                start += t.num_rows - batch.num_rows
                start = np.r_[0, start] if held else start
                yield from drawn(t.slice(0, start[-1]), start[:-1])
                held = t.slice(start[-1]).to_batches()
            else:
                held.append(batch)
        if held:
            yield from drawn(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    return rows.mapInArrow(scores, f"key {kind}, score double").withColumnRenamed("key", key)


def oriented_normals(df: DataFrame, groups: list[str], key: str, k: int = 24, passes: int = 4, crease: float = 35.0, pixels: int = 96) -> DataFrame:
    """(key, nx, ny, nz): unit normals. The direction is that of the plane through the k nearest records, weighted by opacity; the side
    is that of the cameras of a ring which see the record in their depth map; records that none sees follow their neighbours, in up
    to ``passes`` rounds; then normals are smoothed among neighbours that face within ``crease`` degrees. A group is one chunk's
    records at an instant, which the format bounds."""
    rows = df.select(*groups, F.col(key).alias("key"), *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z", "o")])
    kind = dict(rows.dtypes)["key"]
    views = ring_of_views(8, (-0.5, 0.2, 0.8))

    def normals(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
        w = np.maximum(t.column("o").to_numpy(), 1e-6)
        near, _ = nearest_rows(x, min(k, len(x)), True)
        ww = np.where(near >= 0, w[near], 0)
        c = x[near] - ((ww[:, :, None] * x[near]).sum(1) / ww.sum(1)[:, None])[:, None]
        _, vec = np.linalg.eigh(np.einsum("nk,nki,nkj->nij", ww, c, c))
        n = vec[:, :, 0]
        # votes: towards each camera in whose depth map the record lies in front
        mid, span = (x.max(0) + x.min(0)) / 2, max((x.max(0) - x.min(0)).max(), 1e-9)
        votes = np.zeros_like(x)
        size = int(np.clip(0.35 * math.sqrt(len(x)), 8, pixels))  # coarse enough that a surface leaves no holes to look through
        for r, u, f in views:
            p = (x - mid) / span
            cell = (np.floor((p @ r + 0.9) * size) * 4 * size + np.floor((p @ u + 0.9) * size)).astype(np.int64)
            depth = p @ f
            cells, at = np.unique(cell, return_inverse=True)
            front = np.full(len(cells), np.inf)
            np.minimum.at(front, at, depth)
            votes[depth <= front[at] + 1.5 / size] -= f
        side = np.einsum("ni,ni->n", n, votes)
        known = np.abs(side) > 1e-6
        n = np.where((side < 0)[:, None], -n, n)
        for _ in range(passes):
            if known.all():
                break
            field = (np.where(known[near], ww, 0)[:, :, None] * n[near]).sum(1)
            facing = np.einsum("ni,ni->n", n, field)
            new = ~known & (np.abs(facing) > 1e-9)
            if not new.any():
                break
            n = np.where((new & (facing < 0))[:, None], -n, n)
            known |= new
        for _ in range(passes):
            alike = np.einsum("nki,ni->nk", n[near], n) >= math.cos(math.radians(crease))
            mean = (np.where(alike, ww, 0)[:, :, None] * n[near]).sum(1)
            size = np.linalg.norm(mean, axis=1, keepdims=True)
            n = n + np.where(size > 1e-6, mean / np.maximum(size, 1e-300), 0)
            n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        return pa.table({"key": t.column("key"), "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    return rows.groupBy(*groups).applyInArrow(normals, f"key {kind}, nx double, ny double, nz double").withColumnRenamed("key", key)


def recover_colour(df: DataFrame, groups: list[str], key: str, seed: Column, candidate: Column, link: float = 0.02, least: int = 250, extent: float = 0.12, reach: float = 0.055, eighth: float = 0.05) -> DataFrame:
    """(key, dr, dg, db): how far candidates may move back from their corrected colour (r, g, b) towards their source colour (r0, g0,
    b0), led by the colours of coherent surfaces around them.

    Seeds within ``link`` of each other form surfaces; those of ``least`` seeds and a diagonal above ``extent`` are references. Up to
    sixteen references within ``reach`` (the eighth within ``eighth``) give a colour per luminance, weighted by opacity over squared
    distance, equally near ones in the order of their keys; the shift is held to 0.2 and never passes the source. Surfaces are found through
    cells of a grid, references by the task that holds the group: one chunk's records, which the format bounds."""
    s = df.where(seed).select(*groups, key, "x", "y", "z", "o", "r", "g", "b")
    part = components(s, groups, key, link, least)
    span = sum(((F.max(a) - F.min(a)) ** 2 for a in "xyz"), F.lit(0.0))
    good = s.select(key, "x", "y", "z").join(part, key).groupBy("component").agg(span.alias("q")).where(F.col("q") > extent * extent).select("component")
    ref = s.join(part.join(good, "component").select(key), key, "left_semi")
    light = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722
    # what has no luminance has no colour per luminance, and leads nothing
    ref = ref.where(light > 0)
    own = df.where(candidate)
    put = lambda df, *cols: df.where(" and ".join([*(f"{g} is not null" for g in groups), *(f"abs({a}) < double('infinity')" for a in "xyz")])).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *cols)])
    ref, own = put(ref, "o", "r", "g", "b"), put(own, "r", "g", "b", "r0", "g0", "b0")
    kind, luma = dict(own.dtypes)["key"], np.array([0.2126, 0.7152, 0.0722])

    def led(t: pa.Table, u: pa.Table) -> pa.Table:
        get = lambda q, *names: np.stack([q.column(c).to_numpy() for c in names], 1)
        t, u = (t, u.sort_by("key")) if t.num_rows and u.num_rows else (t.slice(0, 0), u.slice(0, 0))  # of equally near ones the first
        x, y, c, o = get(t, "x", "y", "z"), get(u, "x", "y", "z"), get(u, "r", "g", "b"), u.column("o").to_numpy()
        at, _ = nearest_rows(x, 16, among=y)
        q = np.where(at >= 0, ((x[:, None] - y[at]) ** 2).sum(2), np.inf) if len(y) else np.full(at.shape, np.inf)
        ok = np.flatnonzero((q[:, 7] < min(eighth, reach) ** 2) if len(x) else [])
        at, q, now, was = at[ok], q[ok], get(t, "r", "g", "b")[ok], get(t, "r0", "g0", "b0")[ok]
        w = np.where(q < reach * reach, o[at] / np.maximum(q, 0.002 * 0.002), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            aim = (w[:, :, None] * (c / (c @ luma)[:, None])[at]).sum(1) / w.sum(1)[:, None] * (now @ luma)[:, None]
        shift = 0.95 * np.clip(np.clip(aim - now, -0.2, 0.2), np.minimum(was - now, 0), np.maximum(was - now, 0))
        return pa.table({"key": t.column("key").take(pa.array(ok)), **dict(zip(("dr", "dg", "db"), shift.T))})

    names = [f"_g{i}" for i in range(len(groups))]
    return own.groupBy(*names).cogroup(ref.groupBy(*names)).applyInArrow(led, f"key {kind}, dr double, dg double, db double").withColumnRenamed("key", key)


def likest_partner(left: DataFrame, right: DataFrame, groups: list[str], key: str, colour: float = 0.05) -> DataFrame:
    """(key, partner, distance): of every row of ``left`` the row of ``right`` in its group that is nearest in position and, a unit of
    colour counting as ``colour``, in colour; ties to the smaller key. Groups are the records of one frame."""
    cols = ["x", "y", "z", "r", "g", "b"]
    pick = lambda df: df.select(*groups, F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in cols])
    a, b = pick(left), pick(right)
    kind = dict(a.dtypes)["key"]

    def match(t: pa.Table, u: pa.Table) -> pa.Table:
        if not t.num_rows or not u.num_rows:
            return pa.table({"key": pa.array([], t.column("key").type), "partner": pa.array([], u.column("key").type), "distance": pa.array([], pa.float64())})
        f = lambda q: np.stack([*[q.column(c).to_numpy() for c in "xyz"], *[colour * np.clip(q.column(c).to_numpy(), 0, 1) for c in "rgb"]], 1)
        o = np.argsort(u.column("key").to_numpy(), kind="stable")
        x, y = f(t), f(u)[o]
        best, dist = (c[:, 0] for c in nearest_rows(x, 1, among=y))
        return pa.table({"key": t.column("key"), "partner": u.column("key").take(pa.array(o[best])), "distance": dist})

    return a.groupBy(*groups).cogroup(b.groupBy(*groups)).applyInArrow(match, f"key {kind}, partner {kind}, distance double").withColumnRenamed("key", key)
