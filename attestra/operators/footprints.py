"""Footprints: the concave hull of a group's points, widened by so many metres. Rings are arrays of (lng, lat)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved
from .shapes import BUFFER_M, corners, hull_points
from .tiles import by_groups

#: Longest edge kept, as a share of the way from the shortest to the longest edge of the triangulation.
RATIO = 0.8
#: Corners of a circle, metres of a degree, and steps of a degree to which positions are taken (0.1 m), so that predicates are exact integers.
CORNERS, DEGREE_M, STEPS = 32, 111_195.0, 1_000_000
#: Positions of a group beyond which its hull is convex, for callers that want it so; None: never.
MOST: int | None = None
#: Positions of a group or tile that are triangulated at once; a group with more goes by tiles, to the same hull.
WHOLE = 4096
#: Bits of the sides of the least tile and of the one that holds all, and by how many a tile is longer than those before.
LEAST_SIDE, ALL_SIDE, GROWTH = 9, 29, 2
GHOST = -1
#: What a row of a tile is.
POSITION, BORDER, LONG, SIZES, HULL = range(5)


Point = tuple[int, int]


def _turn(a: Point, b: Point, c: Point) -> int:
    """Twice the area of a, b, c; positive if they turn left."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a: Point, b: Point, c: Point, q: Point) -> bool:
    """Whether q lies strictly inside the circle of a counter-clockwise triangle."""
    ax, ay, bx, by, cx, cy = a[0] - q[0], a[1] - q[1], b[0] - q[0], b[1] - q[1], c[0] - q[0], c[1] - q[1]
    return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def triangles(p: list[Point]) -> dict[tuple[int, int], int]:
    """The Delaunay triangles of distinct integer points in ascending order: each directed edge with the third corner on its left. Empty if all lie on a line.

    Points are put in from west to east, so each lies outside of what is there and sees an edge of the point before it; triangles whose
    circle holds it are opened. The outside is made of triangles with a ghost corner.
    """
    far = next((k for k in range(2, len(p)) if _turn(p[0], p[1], p[k])), None)
    if far is None:
        return {}
    third: dict[tuple[int, int], int] = {}

    def put(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    left = _turn(p[0], p[1], p[far]) > 0
    for i in range(far - 1):
        put(*((i, i + 1, far) if left else (i + 1, i, far)))
    for a, b in list(third):
        if (b, a) not in third:
            put(b, a, GHOST)

    def opened(a: int, b: int, c: int, q: Point) -> bool:
        if GHOST not in (a, b, c):
            return _in_circle(p[a], p[b], p[c], q)
        while c != GHOST:
            a, b, c = b, c, a
        u, v = p[a], p[b]
        turn = _turn(u, v, q)
        return turn > 0 or turn == 0 and (q[0] - u[0]) * (q[0] - v[0]) + (q[1] - u[1]) * (q[1] - v[1]) < 0

    for k in range(far + 1, len(p)):
        q = p[k]
        beside = third[GHOST, k - 1]
        first = (k - 1, beside, GHOST) if opened(k - 1, beside, GHOST, q) else (third[k - 1, GHOST], k - 1, GHOST)
        stack, rim = [first], []
        for edge in ((first[0], first[1]), (first[1], first[2]), (first[2], first[0])):
            del third[edge]
        while stack:
            a, b, c = stack.pop()
            for s, e in ((a, b), (b, c), (c, a)):
                top = third.get((e, s))
                if top is None:
                    continue  # open already
                if opened(e, s, top, q):
                    del third[e, s], third[s, top], third[top, e]
                    stack.append((e, s, top))
                else:
                    rim.append((s, e))
        for s, e in rim:
            put(s, e, k)
    return {edge: top for edge, top in third.items() if GHOST not in (*edge, top)}


def concave(points: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """The rows of the concave hull's corners, counter-clockwise: all points lie in it or on it, and it is one piece without holes.

    From the triangulation, the outermost triangle with the longest outer edge goes, as long as that edge is longer than `ratio` of
    the way from the shortest edge to the longest, and unless its third corner is on the outline already (it would be pinched).
    One or two points, or points on a line, give the ends.
    """
    grid, at = np.unique(np.round(points * STEPS).astype(np.int64), axis=0, return_index=True)
    p = [(x, y) for x, y in grid.tolist()]
    third = triangles(p)
    if not third:
        return at[[0, -1]] if len(grid) > 1 else at
    sizes = [_square(p[s], p[e]) for s, e in third]
    return at[_eroded({s: e for s, e in third if (e, s) not in third}, third, _limit(min(sizes), max(sizes), ratio), lambda s, e: _square(p[s], p[e]))]


def _square(a: Point, b: Point) -> int:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def _limit(least: int, most: int, ratio: float) -> float:
    """The longest edge kept, from the squares of the shortest and the longest."""
    return math.sqrt(least) + ratio * (math.sqrt(most) - math.sqrt(least))


def _eroded(following: dict, third: dict, limit: float, square: Callable[..., int]) -> list:
    """The outline of a triangulation after its long outer edges went, from the least corner on; third has to know the triangles with an edge over the limit only."""
    length = lambda s, e: math.sqrt(square(s, e))
    queue = [(-length(s, e), s, e) for s, e in following.items()]
    heapq.heapify(queue)
    while queue and -queue[0][0] > limit:
        _, s, e = heapq.heappop(queue)
        top = third[s, e]
        if top in following:
            continue
        following[s], following[top] = top, e
        for edge in ((s, top), (top, e)):
            heapq.heappush(queue, (-length(*edge), *edge))
    ring = [min(following)]
    while following[ring[-1]] != ring[0]:
        ring.append(following[ring[-1]])
    return ring


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest (x, y) that the circles of triangles reach, rounded outwards."""
    a = p[tri[:, 0]]
    (bx, by), (cx, cy) = (p[tri[:, 1]] - a).T, (p[tri[:, 2]] - a).T
    twice = 2.0 * (bx * cy - cx * by)
    b2, c2 = (v * v + w * w for v, w in ((bx.astype(float), by.astype(float)), (cx.astype(float), cy.astype(float))))
    middle = np.stack([cy * b2 - by * c2, bx * c2 - cx * b2], axis=1) / twice[:, None]
    error = 1e-15 * (np.abs(cy) * b2 + np.abs(by) * c2 + np.abs(bx) * c2 + np.abs(cx) * b2) / np.abs(twice)
    reach = (np.hypot(*middle.T) * (1 + 1e-12) + 4 * error + 1e-3)[:, None]
    return a + middle - reach, a + middle + reach


def settled(p: list[Point], border: list[tuple[Point, Point]], box: tuple[int, int, int] | None, ratio: float) -> list[tuple]:
    """The rows (what, least, most, and up to six coordinates) that a tile sends on, of its positions in ascending order.

    A triangle whose circle lies in the tile's box (x, y, side; None: all there is) is one whatever lies elsewhere. It is settled: the
    tile tells the shortest and the longest edge (squared), and triangles with an edge that may be over the limit. The positions of
    others, or on the outline, go on with the directed edges that have a settled triangle on their left. What is found within such
    edges of former tiles was settled there.
    """
    third = triangles(p)
    if not third:
        ends = [(HULL, 0, 0, *p[0], *p[-1], 0, 0)] if box is None else []
        return ends or [(POSITION, 0, 0, *q, 0, 0, 0, 0) for q in p]
    tri = [(s, e, t) for (s, e), t in third.items() if s < e and s < t]
    of = {edge: k for k, (a, b, c) in enumerate(tri) for edge in ((a, b), (b, c), (c, a))}
    done = np.zeros(len(tri), bool)
    if border:
        at = {q: i for i, q in enumerate(p)}
        edges = {(at[a], at[b]) for a, b in border}
        stack = [of[e] for e in edges]
        while stack:
            k = stack.pop()
            if done[k]:
                continue
            done[k] = True
            a, b, c = tri[k]
            stack += [of[e, s] for s, e in ((a, b), (b, c), (c, a)) if (s, e) not in edges]
    q, corners_of = np.array(p, np.int64), np.array(tri, np.int64)
    new = ~done
    if box is not None:
        low, high = _circles(q, corners_of)
        first = np.array(box[:2])
        new &= (low > first - 1).all(axis=1) & (high < first + box[2]).all(axis=1)
    out: list[tuple] = []
    if new.any():
        t = q[corners_of[new]]
        squares = ((t - np.roll(t, -1, axis=1)) ** 2).sum(axis=2)
        least, most, longest = int(squares.min()), int(squares.max()), squares.max(axis=1)
        out.append((SIZES, least, most, 0, 0, 0, 0, 0, 0))
        long = np.sqrt(longest) > ratio * math.sqrt(most) - 1
        out += [(LONG, 0, m, *r) for m, r in zip(longest[long].tolist(), t[long].reshape(-1, 6).tolist(), strict=True)]
    outline = [(s, e) for s, e in third if (e, s) not in third]
    if box is None:
        return out + [(HULL, 0, 0, *p[s], *p[e], 0, 0) for s, e in outline]
    done |= new
    kept = {s for s, _ in outline} | set(np.unique(corners_of[~done]).tolist())
    out += [(POSITION, 0, 0, *p[i], 0, 0, 0, 0) for i in sorted(kept)]
    for k in np.flatnonzero(done).tolist():
        a, b, c = tri[k]
        for s, e in ((a, b), (b, c), (c, a)):
            beside = of.get((e, s))
            if beside is None or not done[beside]:
                out.append((BORDER, 0, 0, *p[s], *p[e], 0, 0))
    return out


_ROW = ("least", "most", "ax", "ay", "bx", "by", "cx", "cy")


def concave_by_tiles(positions: DataFrame, key: str, ratio: float = RATIO) -> DataFrame:
    """key, x, y, place: the corners of `concave` in order, for keys of any number of positions (x, y in steps), none of them twice.

    Small tiles settle the triangles that nothing outside can change and send on what lies along their edges; larger tiles go on
    with that, up to one for all of a key. So a task holds some WHOLE positions and the edges of a few tiles, the last one those
    along a key's long empty stretches; only triangles with an edge that may be over the limit meet at the end.
    """
    kind = positions.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, what int, ty bigint, tx bigint, " + ", ".join(f"{c} bigint" for c in _ROW)
    half = 1 << ALL_SIDE - 1
    zero = F.lit(0).cast("bigint")
    rows = saved(positions.select(key, F.lit(POSITION).alias("what"), zero.alias("ty"), zero.alias("tx"), zero.alias("least"), zero.alias("most"), (F.col("x") + half).alias("ax"), (F.col("y") + half).alias("ay"), *(zero.alias(c) for c in _ROW[4:])), "tile")
    sides = list(range(LEAST_SIDE, ALL_SIDE, GROWTH))
    tiles = rows.groupBy(key, F.shiftright("ay", LEAST_SIDE).alias("ty"), F.shiftright("ax", LEAST_SIDE).alias("tx")).agg(F.count(F.lit(1)).alias("n"))
    larger = tiles.select(key, "n", F.inline(F.array(*(F.struct(F.lit(b).alias("side"), F.shiftright("ty", b - LEAST_SIDE).alias("ty"), F.shiftright("tx", b - LEAST_SIDE).alias("tx")) for b in sides))))
    start = larger.groupBy(key, "side", "ty", "tx").agg(F.sum("n").alias("n")).where(F.col("n") > WHOLE).agg(F.min("side")).first()[0]

    def level(side: int) -> Callable[[pa.Table, np.ndarray], pa.Table]:
        def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
            what, ty, tx = (rows[c].to_numpy() for c in ("what", "ty", "tx"))
            xy = np.column_stack([rows[c].to_numpy() for c in _ROW[2:]])
            owner, found = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here = xy[a:b]
                p = sorted(map(tuple, here[what[a:b] == POSITION][:, :2].tolist()))
                border = [((x, y), (u, v)) for x, y, u, v in here[what[a:b] == BORDER][:, :4].tolist()]
                if side < ALL_SIDE and len(p) <= WHOLE:
                    new = [(POSITION, 0, 0, *q, 0, 0, 0, 0) for q in p] + [(BORDER, 0, 0, *s, *e, 0, 0) for s, e in border]
                else:
                    new = settled(p, border, None if side >= ALL_SIDE else (int(tx[a]) << side, int(ty[a]) << side, 1 << side), ratio)
                found += new
                owner += [a] * len(new)
            cells = np.array(found, np.int64).reshape(-1, 9)
            at = pa.array(np.array(owner, np.int64))
            return pa.table({key: rows[key].take(at), "what": pa.array(cells[:, 0], pa.int32()), "ty": rows["ty"].take(at), "tx": rows["tx"].take(at), **{c: pa.array(cells[:, i + 1]) for i, c in enumerate(_ROW)}})

        return work

    out, before = None, None
    for side in [*(b for b in sides if start is not None and b >= start), ALL_SIDE]:
        up = (lambda c, v, side=side: F.shiftright(v, side)) if before is None else (lambda c, v, by=side - before: F.shiftright(c, by))
        dealt = rows.withColumn("ty", up(F.col("ty"), F.col("ay"))).withColumn("tx", up(F.col("tx"), F.col("ax")))
        made = saved(by_groups(dealt, [key, "ty", "tx"], level(side), schema), "tile")
        kept = made.where(F.col("what") > BORDER)
        out = kept if out is None else out.unionByName(kept)
        rows, before = made.where(F.col("what") <= BORDER), side

    def outline(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        what, least, most = (rows[c].to_numpy() for c in ("what", "shortest", "longest"))
        xy = np.column_stack([rows[c].to_numpy() for c in _ROW[2:]])
        owner, found = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = xy[a:b]
            following = {(x, y): (u, v) for x, y, u, v in here[what[a:b] == HULL][:, :4].tolist()}
            third = {}
            for x, y, u, v, w, z in here[what[a:b] == LONG].tolist():
                third[(x, y), (u, v)], third[(u, v), (w, z)], third[(w, z), (x, y)] = (w, z), (x, y), (u, v)
            ring = _eroded(following, third, _limit(int(least[a]), int(most[a]), ratio), _square) if len(following) > 1 else [q for e in following.items() for q in e]
            owner += [a] * len(ring)
            found += [(x - half, y - half, i) for i, (x, y) in enumerate(ring)]
        cells = np.array(found, np.int64).reshape(-1, 3)
        return pa.table({key: rows[key].take(pa.array(np.array(owner, np.int64))), **{c: pa.array(cells[:, i]) for i, c in enumerate(("x", "y", "place"))}})

    sizes = out.where(F.col("what") == SIZES).groupBy(key).agg(F.min("least").alias("shortest"), F.max("most").alias("longest"))
    limit = F.sqrt("shortest") + ratio * (F.sqrt("longest") - F.sqrt("shortest"))
    ends = out.where(F.col("what").isin(LONG, HULL)).join(sizes, key, "left").na.fill(0, ["shortest", "longest"])
    ends = ends.where((F.col("what") == HULL) | (F.sqrt("most") > limit - 1)).select(key, "what", "shortest", "longest", *_ROW[2:])
    return by_groups(ends, [key], outline, f"{key} {kind}, x bigint, y bigint, place bigint")


def _offset(ring: np.ndarray, metres: float) -> np.ndarray:
    """The curve `metres` outside a counter-clockwise ring (in metres): arcs about corners that turn left, detours by the others."""
    if len(ring) == 1:
        angle = np.arange(CORNERS) * 2 * np.pi / CORNERS
        return ring + metres * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    ahead = np.roll(ring, -1, axis=0) - ring
    normal = np.stack([ahead[:, 1], -ahead[:, 0]], axis=1) / np.linalg.norm(ahead, axis=1)[:, None]
    step = 2 * np.pi / CORNERS
    out: list[np.ndarray] = []
    for corner, n1, n2 in zip(ring, np.roll(normal, 1, axis=0), normal, strict=True):
        turn = n1[0] * n2[1] - n1[1] * n2[0]
        if turn < -1e-12:
            out += [corner + metres * n1, corner, corner + metres * n2]
            continue
        start = math.atan2(n1[1], n1[0])
        sweep = math.atan2(turn, float(n1 @ n2)) % (2 * math.pi)
        at = np.array([start, *(start + np.arange(step, sweep - 1e-9, step)), *([start + sweep] if sweep > 1e-9 else [])])
        out += list(corner + metres * np.stack([np.cos(at), np.sin(at)], axis=1))
    return np.array(out)


def _outer(curve: np.ndarray) -> np.ndarray | None:
    """The outer boundary of a closed curve that crosses itself: cut at all crossings, then walked with the region on the left. None if the walk does not close."""
    p = np.round(curve * 1000).astype(np.int64)  # millimetres
    p = p[np.any(p != np.roll(p, 1, axis=0), axis=1)]
    q = np.roll(p, -1, axis=0)
    d = (q - p).astype(float)
    cuts: list[list[tuple[float, tuple[int, int]]]] = [[(0.0, tuple(p[i].tolist())), (1.0, tuple(q[i].tolist()))] for i in range(len(p))]
    for i in range(len(p)):
        w = (p - p[i]).astype(float)
        cross = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / cross, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        for j in np.flatnonzero((cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)):
            cuts[i].append((float(t[j]), tuple(np.round(p[j] + u[j] * d[j] if 0 < u[j] < 1 and i > j else p[i] + t[j] * d[i]).astype(np.int64).tolist())))
    beside: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for row in cuts:
        at = [node for _, node in sorted(row)]
        for a, b in zip(at, at[1:], strict=False):
            if a != b:
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
    start = min(beside)
    ring, here, back = [start], start, math.pi
    for _ in range(4 * len(beside) + 4):
        turn = lambda n: (math.atan2(n[1] - here[1], n[0] - here[0]) - back) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
        there = min(beside[here], key=turn)
        if len(ring) > 1 and here == start and there == ring[1]:
            return np.array(ring[:-1]) / 1000.0
        back, here = math.atan2(here[1] - there[1], here[0] - there[0]), there
        ring.append(here)
    return None


def footprint(points: np.ndarray, metres: float = BUFFER_M, of: Callable[[np.ndarray], np.ndarray] = concave) -> np.ndarray:
    """The hull of points by `of`, widened by `metres`: a disc for one point, a capsule for two. Its outer ring; what lies within it is no hole.

    Metres are those of the points' middle latitude. Where the outer ring can't be walked, the convex hull is widened.
    """
    core = points[of(points)]
    scale = np.array([DEGREE_M * max(0.01, math.cos(math.radians((core[:, 1].min() + core[:, 1].max()) / 2))), DEGREE_M])
    middle = core.mean(axis=0)
    curve = _offset((core - middle) * scale, metres)
    ring = _outer(curve)
    if ring is None:
        ring = _offset((points[corners(points)] - middle) * scale, metres)
    return ring / scale + middle


def footprints(members: DataFrame, key: str) -> DataFrame:
    """key, ring (of lng, lat) and concave (whether a concave hull was made) for each key's points; rows without key or place are left out.

    Positions are taken to steps of 0.1 m; equal ones are one. Every key gets its widened concave hull, one with more than WHOLE
    positions by tiles, so that no task holds a whole large group. Extra columns are not read.
    """
    kind = members.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ring array<struct<lng: double, lat: double>>, concave boolean"
    step = lambda c: F.rint(F.col(c) * STEPS).cast("bigint")
    points = members.where(F.col(key).isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull()).select(key, step("lng").alias("x"), step("lat").alias("y")).distinct()
    points = saved(points, "positions")
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def made(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table, np.ndarray], pa.Table]:
        def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
            at = np.column_stack([rows["x"].to_numpy(), rows["y"].to_numpy()]) / STEPS
            rings = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                by = np.argsort(rows["place"][a:b].to_numpy()) if "place" in rows.column_names else slice(None)
                rings.append(footprint(at[a:b][by], of=of))
            corners_of = [[{"lng": float(x), "lat": float(y)} for x, y in ring] for ring in rings]
            kind = pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())]))
            return pa.table({key: rows[key].take(pa.array(starts[:-1])), "ring": pa.array(corners_of, kind), "concave": pa.array([of is not corners] * len(rings))})

        return work

    over = saved(counts.where(F.col("n") > (WHOLE if MOST is None else MOST)).select(key), "over")
    small = by_groups(points.join(over, key, "left_anti"), [key], made(concave), schema)
    if over.isEmpty():
        return small
    large = points.join(over, key, "left_semi")
    if MOST is not None:
        at = hull_points(large.select(key, (F.col("x") / STEPS).alias("lng"), (F.col("y") / STEPS).alias("lat")), key, corners)
        return small.unionByName(by_groups(at.select(key, step("lng").alias("x"), step("lat").alias("y")), [key], made(corners), schema))
    return small.unionByName(by_groups(concave_by_tiles(large, key), [key], made(lambda ring: np.arange(len(ring))), schema))
