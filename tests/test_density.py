"""Density clustering against plain walks over whole matrices."""

import random
from collections import defaultdict

import pytest

from etherloom.operators import density, steep


def matrix_of(spark, scenarios, kind="long"):
    """Rows i <= j of each scenario's square distances."""
    rows = [(s, i, j, float(d[i][j])) for s, (names, d) in scenarios.items() for a, i in enumerate(names) for j in names[a:]]
    return spark.createDataFrame(rows, f"scenario string, i {kind}, j {kind}, distance double")


def points(draw, n, step=None, spread=1.0):
    """Distances of points in a plane, in steps if many are to be equal; names are not consecutive."""
    names = sorted(draw.sample(range(10**12, 10**12 + 10 * n), n))
    xy = {m: (draw.choice((0, 9, 30)) + draw.gauss(0, spread), draw.gauss(0, spread)) for m in names}
    cut = (lambda x: x) if step is None else (lambda x: round(x / step) * step)
    return names, {i: {j: cut(((xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2) ** 0.5) for j in names} for i in names}


def plain_core(names, d, k=2):
    return {i: sorted(d[i][j] for j in names)[k - 1] if len(names) >= k else None for i in names}


def plain_walk(names, w):
    """(mac, reachability, predecessor) by taking the least edge (weight, i, j) from what is visited."""
    order, seen = [(names[0], None, None)], {names[0]}
    while len(seen) < len(names):
        x, i, j, new, old = min((w[a][b], min(a, b), max(a, b), b, a) for a in seen for b in names if b not in seen)
        seen.add(new)
        order.append((new, x, old))
    return order


def plain_tree(names, w):
    top = {m: m for m in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    out = set()
    for x, i, j in sorted((w[i][j], i, j) for a, i in enumerate(names) for j in names[a + 1 :]):
        if find(i) != find(j):
            top[find(i)] = find(j)
            out.add((i, j, x))
    return out


@pytest.fixture(scope="module")
def scenarios():
    draw = random.Random(11)
    found = {"free": points(draw, 40), "ties": points(draw, 35, 1.0), "equal": points(draw, 20, 1000.0), "one": points(draw, 1), "two": points(draw, 2)}
    found["line"] = (list(range(30)), {i: {j: float(abs(i - j) * (i + j)) for j in range(30)} for i in range(30)})  # merges one at a time
    for i in found["free"][0][::3]:
        found["free"][1][i][i] = 0.5  # its own distance is not the least
    return found


def weights(names, d):
    core = plain_core(names, d)
    return {i: {j: max(d[i][j], core[i] or 0, core[j] or 0) for j in names} for i in names}


@pytest.mark.parametrize("chunk, block", [(50_000, 2000), (7, 5)])
def test_cores_tree_and_order_equal_a_plain_walk(spark, scenarios, monkeypatch, chunk, block):
    monkeypatch.setattr(density, "BLOCK", block)
    matrix = matrix_of(spark, scenarios)
    core = density.core_distances(matrix)
    got = defaultdict(dict)
    for r in core.collect():
        got[r["scenario"]][r["mac"]] = r["core"]
    assert got == {s: plain_core(*x) for s, x in scenarios.items()}
    tree = density.spanning_tree(density.reach_edges(matrix, core))
    rows = {s: set() for s in scenarios}
    for r in tree.collect():
        rows[r["scenario"]].add((r["i"], r["j"], r["weight"]))
    assert rows == {s: plain_tree(n, weights(n, d)) for s, (n, d) in scenarios.items()}
    order = defaultdict(list)
    for r in sorted(density.visiting_order(tree, core, chunk).collect(), key=lambda r: (r["scenario"], r["pos"])):
        assert r["pos"] == len(order[r["scenario"]])
        order[r["scenario"]].append((r["mac"], r["reachability"], r["predecessor"]))
    assert order == {s: plain_walk(n, weights(n, d)) for s, (n, d) in scenarios.items()}


def test_forests_names_and_nothing(spark):
    edges = spark.createDataFrame([("s", "a", "d", 2.0), ("s", "b", "c", 1.0), ("s", "d", "e", 2.0)], "scenario string, i string, j string, weight double")
    macs = spark.createDataFrame([("s", x) for x in "abcdef"], "scenario string, mac string")
    found = sorted(map(tuple, density.visiting_order(density.spanning_tree(edges), macs, 1).collect()))
    assert found == [("s", 0, "a", None, None), ("s", 1, "d", 2.0, "a"), ("s", 2, "e", 2.0, "d"), ("s", 3, "b", None, None), ("s", 4, "c", 1.0, "b"), ("s", 5, "f", None, None)]
    assert density.visiting_order(density.spanning_tree(edges.limit(0)), macs.limit(0)).collect() == []


def plain_clusters(order, xi, min_samples, size):
    """Labels along a plot by one walk over it: open falling areas, each with the highest point since it ended."""
    n, share = len(order), 1 - xi
    at = {m: k for k, (m, _, _) in enumerate(order)}
    r = [float("inf") if x is None else x for _, x, _ in order] + [float("inf")]
    before = [None if p is None else at[p] for _, _, p in order]
    falls = [r[k] > r[k + 1] and r[k] * share >= r[k + 1] for k in range(n)]
    rises = [r[k] < r[k + 1] and r[k] <= r[k + 1] * share for k in range(n)]

    def extent(k, steep, against):
        end, flat = k, 0
        while k < n:
            if steep[k]:
                end, flat = k, 0
            elif against(k):
                break
            else:
                flat += 1
                if flat > min_samples:
                    break
            k += 1
        return end

    found, opened, k, high = [], [], 0, 0.0
    while k < n:
        high = max(high, r[k])
        if not (falls[k] or rises[k]):
            k += 1
            continue
        opened = [] if high == float("inf") else [(a, b, max(m, high)) for a, b, m in opened if high <= r[a] * share]
        if falls[k]:
            end = extent(k, falls, lambda x: r[x] < r[x + 1])
            opened.append((k, end, 0.0))
        else:
            end = extent(k, rises, lambda x: r[x] > r[x + 1])
            for first, last, m in reversed(opened):
                s, e = first, end
                if r[e + 1] * share < m:
                    continue
                if r[first] * share >= r[e + 1]:
                    while s < last and r[s + 1] > r[e + 1]:
                        s += 1
                elif r[e + 1] * share >= r[first]:
                    while e > k and r[e - 1] > r[first]:
                        e -= 1
                while e > s and not (r[s] > r[e] or before[e] is not None and before[e] >= s):
                    e -= 1
                if e > s and e - s + 1 >= size and e >= k and s <= last:
                    found.append((s, e))
        k, high = end + 1, r[end + 1]
    label, out = 0, [-1] * n
    for s, e in found:
        if all(x == -1 for x in out[s : e + 1]):
            out[s : e + 1] = [label] * (e - s + 1)
            label += 1
    return out


def plots(draw):
    """Orders with heights of many shapes: noise, valleys in valleys, steps with ties, restarts, few points."""
    shapes = {
        "noise": [draw.random() for _ in range(200)], "steps": [draw.choice((0, 0.0, 1, 1.04, 2, 4)) for _ in range(200)],
        "walk": [], "valleys": [5 + 4 * abs((k % 40) - 20) / 20 + draw.random() * 0.1 for k in range(200)], "few": [3.0, 1.0, 1.0, 1.0, 3.0],
        "nested": [abs(k % 64 - 32) / 8 + abs(k % 16 - 8) / 4 + draw.choice((0, 0.01)) for k in range(256)], "zeros": [0.0] * 50, "one": [],
    }
    x = 1.0
    for _ in range(300):
        x *= draw.choice((0.8, 0.94, 0.96, 1.0, 1.0, 1.03, 1.06, 1.25))
        shapes["walk"].append(x)
    found = {}
    for name, heights in shapes.items():
        macs = draw.sample(range(10**6), len(heights) + 1)
        found[name] = [(macs[0], None, None)]
        for k, h in enumerate(heights):
            again = name == "noise" and k % 70 == 69
            origin = draw.choice(macs[max(0, k - draw.choice((0, 3, 40))) : k + 1])
            found[name].append((macs[k + 1], None if again else float(h), None if again else origin))
    return found


@pytest.mark.parametrize("seed, part, samples, size", [(1, 100_000, 2, 15), (2, 7, 2, 15), (3, 50, 1, 3), (4, 3, 4, 5)])
def test_xi_clusters_equal_one_walk(spark, seed, part, samples, size):
    found = plots(random.Random(seed))
    rows = [(s, k, *x) for s, order in found.items() for k, x in enumerate(order)]
    order = spark.createDataFrame(rows, "scenario string, pos long, mac long, reachability double, predecessor long")
    got = defaultdict(dict)
    for r in steep.xi_clusters(order, 0.05, samples, size, part).collect():
        got[r["scenario"]][r["pos"]] = r["cluster"]
    wanted = {s: dict(enumerate(plain_clusters(o, 0.05, samples, size))) for s, o in found.items()}
    assert got == wanted
    assert len({c for s in wanted.values() for c in s.values()}) > 2 and set(wanted["few" if size > 5 else "zeros"].values()) <= {-1, 0}


def test_optics_finds_two_groups_and_needs_enough_points(spark):
    draw = random.Random(8)
    place = [draw.gauss(0, 1) for _ in range(20)] + [100 + draw.gauss(0, 1) for _ in range(25)]
    far = {i: {j: abs(place[i] - place[j]) for j in range(45)} for i in range(45)}
    few = {i: {j: float(abs(i - j)) for j in range(14)} for i in range(14)}
    same = {i: {j: 0.0 for j in range(30)} for i in range(30)}
    found = steep.optics(matrix_of(spark, {"two": (list(range(45)), far), "few": (list(range(14)), few), "same": (list(range(30)), same)}))
    assert found.columns == ["scenario", "pos", "mac", "core", "reachability", "predecessor", "cluster"]
    of = defaultdict(set)
    for r in found.collect():
        of[r["scenario"], r["mac"] >= 20].add(r["cluster"])
    assert of["few", False] == {-1}
    assert of["two", False] - {-1} and of["two", True] - {-1} and not (of["two", False] & of["two", True] - {-1})
    assert len(of["same", False] | of["same", True]) == 1  # one cluster or none: no address is told from another
