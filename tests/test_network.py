"""Lines, components and river paths against walks in plain Python."""

import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest

from gaugeloom.operators import graph, joins, lines, paths, rivers

VERTEX = "line_id long, seq int, x double, y double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vertices(spark, told):
    return spark.createDataFrame([(i, s, float(x), float(y)) for i, p in told for s, (x, y) in enumerate(p)], VERTEX).repartition(3)


def test_components_take_few_rounds(spark):
    rnd = random.Random(1)
    ids = list(range(4000))
    rnd.shuffle(ids)
    path = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:])]
    star = [(9000, 9000 - i) for i in range(1, 200)]
    progress = []
    got = dict(rows_of(graph.components(spark.createDataFrame([*path, *star, (9500, 9501), (9501, 9501), (9600, 9600)], "src long, dst long"), progress)))
    assert len(progress) <= 20 and progress == sorted(progress, reverse=True)
    assert {got[i] for i in ids} == {0} and {got[a] for s in star for a in s} == {8801} and got[9501] == 9500 and got[9600] == 9600
    assert len(got) == 4000 + 200 + 3
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_line_intersections_by_hand(spark):
    told = [(1, [(0, 0), (2, 2), (4, 0)]), (2, [(0, 1), (4, 1)]), (3, [(0, 0), (0, 5)]), (4, [(1, 1), (1, 4)]), (5, [(1, 3), (1, 6)]), (6, [(0.5, -1), (0.5, 6), (0.5, 7)]), (7, [(9, 9), (9, 9)]), (8, [(1, 6), (1, 8)])]
    v = vertices(spark, told)
    # 4 and 5 share a stretch and add nothing; 5 and 8 lie on one line and touch in a point
    assert rows_of(lines.line_intersections(v)) == [(0.0, 0.0), (0.0, 1.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0), (1.0, 6.0), (3.0, 1.0)]
    parts = defaultdict(list)
    for i, part, seq, x, y in sorted(rows_of(lines.split_lines(v, lines.line_intersections(v))), key=lambda r: r[:3]):
        assert seq == len(parts[i, part])
        parts[i, part].append((x, y))
    assert [parts[1, k] for k in range(4)] == [[(0, 0), (0.5, 0.5)], [(0.5, 0.5), (1, 1)], [(1, 1), (2, 2), (3, 1)], [(3, 1), (4, 0)]]
    assert parts[6, 2] == [(0.5, 1.0), (0.5, 6.0), (0.5, 7.0)] and (5, 1) not in parts and parts[4, 0] == [(1, 1), (1, 4)]
    assert lines.line_intersections(v.limit(0)).collect() == [] and lines.split_lines(v.limit(0), v.select("x", "y").limit(0)).collect() == []


def test_crossings_of_all_sizes(spark):
    """Short and very long segments, many of them in one place, against all pairs; each crossing once."""
    rnd = random.Random(3)
    told = []
    for i in range(120):
        size = 10 ** rnd.uniform(-3, 2) if i % 3 else 0.01
        x, y = (rnd.uniform(-1, 1), rnd.uniform(-1, 1)) if i % 3 else (0.5, 0.5)
        told.append((i, [(x + rnd.uniform(-1, 1) * size, y + rnd.uniform(-1, 1) * size) for _ in range(4)]))
    segs = [(i, s, p[s], p[s + 1]) for i, p in told for s in range(3)]
    want = set()
    for i, s, a, b in segs:
        for j, t, c, d in segs:
            if i < j:
                m = np.array([[b[0] - a[0], c[0] - d[0]], [b[1] - a[1], c[1] - d[1]]])
                p, q = np.linalg.solve(m, np.subtract(c, a))
                if 0 <= p <= 1 and 0 <= q <= 1:
                    want.add((i, j, s, t))
    got = [(r.a, r.b, r.a_seq, r.b_seq) for r in lines.segment_crossings(vertices(spark, told)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_streets(spark):
    told = [(10, [(0, 0), (1, 0)]), (11, [(2, 0), (1, 0)]), (12, [(2, 0), (3, 0), (4, 0)]), (20, [(9, 9), (9, 8)]), (21, [(9, 8), (8, 8)]), (22, [(8, 8), (9, 9)]), (30, [(1, 0), (1, 5)]), (40, [(50, 50), (51, 50)]), (50, [(-5, 0.25), (5, 0.25)])]
    v = vertices(spark, told)
    names = spark.createDataFrame([(i, "b" if i in (30, 50) else "a") for i, _ in told], "line_id long, name string")
    got = {(r.name, r.line_id) for r in lines.named_component(v, names, (1.5, -0.5, 2.5, 0.5)).collect()}
    assert got == {("a", 10), ("a", 11), ("a", 12), ("b", 50)}  # 50 crosses the box without a vertex in it; 30 is of another name
    merged = rows_of(lines.merged_lines(v.where("line_id <> 30")))
    assert merged == [(10, 0, 10, False), (10, 1, 11, True), (10, 2, 12, False), (20, 0, 20, False), (20, 1, 21, False), (20, 2, 22, False), (40, 0, 40, False), (50, 0, 50, False)]
    assert {(r.chain, r.line_id) for r in lines.merged_lines(v).collect()} >= {(10, 10), (11, 11), (11, 12), (30, 30)}  # three ends meet at (1, 0)


def network(seed, n=40, m=60):
    rnd = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = rnd.randrange(n), rnd.randrange(n)
        if a != b and (b, a) not in edges:
            edges[a, b] = (rnd.uniform(1, 9), rnd.uniform(1, 9))
    return edges, [(i, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(n)]


def frames(spark, edges, nodes):
    return spark.createDataFrame([(a, b, *w) for (a, b), w in edges.items()], "u long, v long, w1 double, w2 double"), spark.createDataFrame(nodes, "node long, x double, y double")


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_with_direction(spark, seed):
    edges, nodes = network(seed)
    beside = defaultdict(set)
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)

    def hops(a):
        known, queue = {a: 0}, deque([a])
        while queue:
            at = queue.popleft()
            for b in beside[at] - set(known):
                known[b] = known[at] + 1
                queue.append(b)
        return known

    pairs = [(a, b) for a in range(0, 40, 7) for b in range(40)] + [(100, 101), (3, 3)]
    got = defaultdict(list)
    e, at = frames(spark, edges, nodes)
    for r in sorted(rivers.bfs_with_direction(e, at, spark.createDataFrame(pairs, "a long, b long")).collect(), key=lambda r: r.seq):
        got[r.a, r.b].append(r)
    place = {i: np.array(p) for i, *p in nodes}
    for a, b in pairs:
        path = got.get((a, b), [])
        assert len(path) == hops(a).get(b, 0)
        if path:
            assert path[0].src == a and path[-1].dst == b and [r.seq for r in path] == list(range(1, len(path) + 1))
            assert all(x.dst == y.src for x, y in zip(path, path[1:]))
        for r in path:
            assert r.forward == ((r.src, r.dst) in edges)
            assert r.width == (edges[r.src, r.dst][0] if r.forward else edges[r.dst, r.src][1])
            assert np.isclose(r.length, np.linalg.norm(place[r.src] - place[r.dst]))


def test_searches_end_with_their_pairs(spark):
    """A long path: a near pair is closed at once, and the far one meets in the middle."""
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    progress = []
    got = rivers.meeting_paths(e, spark.createDataFrame([(0, 1), (5, 25), (7, 900)], "a long, b long"), progress)
    assert {(r.seq, r.node) for r in got.collect() if r.b == 25} == {(i, 5 + i) for i in range(21)}
    assert progress == [3] + [1] * 9  # the unconnected pair ends when its one end has no further node


def test_contract_chains(spark):
    edges, nodes = network(5, 60, 58)
    edges |= {(200, 201): (1.0, 2.0), (201, 202): (3.0, 4.0), (202, 200): (5.0, 6.0)}  # a ring
    edges |= {(300 + i, 301 + i): (float(i), float(i + 1)) for i in range(100)}  # a long chain
    nodes += [(i, float(i % 7), float(i % 5)) for i in (*range(200, 203), *range(300, 401))]
    keep = [320, 7]
    progress = []
    e, at = frames(spark, edges, nodes)
    got = rivers.contract_chains(e, at, spark.createDataFrame([(k,) for k in keep], "node long"), progress).collect()
    assert len(progress) <= 9
    place = {i: np.array(p) for i, *p in nodes}
    beside = defaultdict(list)
    for a, b in edges:
        beside[a].append((a, b))
        beside[b].append((a, b))
    stays = {x for x in beside if len(beside[x]) != 2 or x in keep}
    want = []
    for start in stays:
        for edge in beside[start]:
            at, steps = start, []
            while True:
                to = edge[1] if edge[0] == at else edge[0]
                steps.append((edge[0] == at, float(np.linalg.norm(place[at] - place[to])), edges[edge][0 if edge[0] == at else 1]))
                at = to
                if at in stays:
                    break
                edge = next(x for x in beside[at] if x != edge)
            if start < at:
                w = np.array([s[2] for s in steps])
                want.append((start, at, len(steps), sum(s[1] for s in steps if s[0]), sum(s[1] for s in steps if not s[0]), w.mean(), w.std(), w.min(), w.max()))
    have = sorted(tuple(r) for r in got if r.src != r.dst)
    assert len(have) == len(want)
    assert np.allclose(np.array(have), np.array(sorted(want)), atol=1e-6)
    assert not any(200 <= r.src <= 202 for r in got)


def test_station_paths_and_true_directions(spark):
    """Two neighbours whose paths meet at node 2 on the way to station 0; a third that isn't connected."""
    at = {1: (0, 0), 2: (1, 0), 3: (2, 1), 4: (2, -1), 8: (50, 50), 9: (51, 50)}
    e = {(2, 1): (3.0, 4.0), (3, 2): (5.0, 6.0), (2, 4): (7.0, 8.0), (8, 9): (1.0, 1.0)}
    edges, nodes = frames(spark, e, [(i, float(x), float(y)) for i, (x, y) in at.items()])
    stations = spark.createDataFrame([(0, -0.1, 0.0), (1, 2.0, 1.1), (2, 2.0, -1.1), (3, 51.0, 50.1)], "station_id long, x double, y double")
    nb = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "station_id long, nb_id long, rank int")
    flat = stations.selectExpr("station_id", "y as lat", "x as lon")
    paths = rivers.station_paths(flat, nb, nodes.selectExpr("node", "y as lat", "x as lon"), edges)
    got = rows_of(paths)
    assert [r[2:] for r in sorted((r for r in got if r[1] == 1), key=lambda r: r[2])] == [(0, 1, None, None), (1, 2, 2, 1), (2, 3, 3, 2)]
    assert [r[2:] for r in got if r[1] == 3] == [(None, None, None, None)]
    rows = {(r.src, r.dst): r for r in rivers.simplify_true_direction(paths, nb, stations, nodes, edges).collect()}
    assert set(rows) == {(-2, 2), (2, -1), (-3, 2)}
    # paths start at the station, so the joining edges are walked backwards; widths are those at the nodes left
    into, other, last = rows[-2, 2], rows[-3, 2], rows[2, -1]
    assert np.isclose(into.forward, 2**0.5) and np.isclose(into.back, 0.1) and (into.least, into.most, into.mean, into.median) == (5.0, 6.0, 5.5, 5.5)
    assert np.isclose(other.forward, 0) and np.isclose(other.back, 0.1 + 2**0.5) and (other.least, other.most) == (8.0, 8.0)
    assert np.isclose(last.forward, 1) and np.isclose(last.back, 0.1) and np.isclose(last.std, 0.5) and (last.least, last.most) == (3.0, 4.0)


def test_nearest_neighbours_far_and_near(spark):
    """Clusters, outliers, one place many times, few points: against all distances."""
    rnd = random.Random(8)
    at = [(rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for _ in range(150)] + [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(30)] + [(3.0, 3.0)] * 9 + [(1000.0, -1000.0)]
    st = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "station_id long, lat double, lon double").repartition(3)
    far = lambda i, j: ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2) ** 0.5
    for df, ok in ((joins.knn_self(st, 4), lambda i, j: i != j), (joins.knn_predecessors(st, 3), lambda i, j: j < i), (joins.knn_ref(st, st.limit(0), 3), lambda i, j: False), (joins.knn_ref(st.where("station_id > 180"), st.where("station_id < 2"), 5), lambda i, j: i > 180 and j < 2)):
        k = 3 if df.columns and ok(1, 0) and not ok(0, 1) else 4 if ok(0, 1) else 5
        got = defaultdict(list)
        for r in sorted(df.collect(), key=lambda r: (r.station_id, r["rank"])):
            got[r.station_id].append(r.nb_id)
        for i in range(len(at)):
            assert got.get(i, []) == [j for _, j in sorted((far(i, j), j) for j in range(len(at)) if ok(i, j))[:k]]


def test_kgrow(spark):
    rnd = random.Random(2)
    at = {i: (rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(60)} | {60: (0.5, 0.5), 61: (0.5, 0.5)}
    st = spark.createDataFrame([(i, *p) for i, p in at.items()], "station_id long, lat double, lon double")
    order, progress = [60], []
    while len(order) < 25:
        order.append(min((((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, b) for a in order for b in at if b not in order)[1])
    assert [r.station_id for r in sorted(joins.kgrow(st, 60, 25, progress).collect(), key=lambda r: r.ord)] == order
    assert len(progress) <= 8
    assert joins.kgrow(st, 999, 5).collect() == [] and joins.kgrow(st.limit(1), st.first().station_id, 5).count() == 1


def test_nearest_line(spark):
    """A long coast of short segments, long segments, points inland and on lines, against all segments."""
    rnd = random.Random(4)
    coast = [(1 + i % 7, 45 + 0.02 * i, 3 + 0.3 * math.sin(i / 9), 45 + 0.02 * (i + 1), 3 + 0.3 * math.sin((i + 1) / 9)) for i in range(400)]
    long = [(20, 40.0, -5.0, 42.0, 12.0), (21, 58.0, -9.0, 59.0, 14.0), (22, 50.0, 8.0, 50.0, 8.0), (5, 45.0, 3.0, 45.0, 3.0)]
    seg = coast + long
    spots = [(rnd.uniform(38, 60), rnd.uniform(-8, 14)) for _ in range(120)] + [(45.0, 3.0), (50.0, 8.0), (49.0, 3.05), (20.0, 40.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "station_id long, lat double, lon double").repartition(3)
    lines_of = spark.createDataFrame([tuple(map(float, x)) for x in seg], "line_id double, lat1 double, lon1 double, lat2 double, lon2 double").selectExpr("cast(line_id as long) line_id", "lat1", "lon1", "lat2", "lon2")

    def place(lat, lon):
        la, lo = np.radians(lat), np.radians(lon)
        return 6371.0 * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=-1)

    s = np.array(seg)
    a, b = place(s[:, 1], s[:, 2]), place(s[:, 3], s[:, 4])
    got = {r.station_id: r for r in paths.nearest_line(df, lines_of).collect()}
    assert len(got) == len(spots)
    for i, (lat, lon) in enumerate(spots):
        p, ab = place(lat, lon), b - a
        d = (ab**2).sum(axis=1)
        t = np.clip(np.where(d > 0, ((p - a) * ab).sum(axis=1) / np.where(d > 0, d, 1), 0), 0, 1)
        km = np.linalg.norm(p - a - t[:, None] * ab, axis=1)
        assert abs(got[i].km - km.min()) < 1e-6 and abs(km[s[:, 0] == got[i].line_id].min() - km.min()) < 1e-6
    assert [tuple(r) for r in paths.nearest_line(df.where("station_id = 3"), lines_of.limit(0)).collect()] == [(3, None, None)]
