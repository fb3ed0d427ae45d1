"""Network measures on random networks, against searches made anew for every question."""

import math
import random

import numpy as np
import pytest

from gridspark.operators import graph, walks


def network(r, n, m, far=6):
    """Edges u, v, key, w with loops, parallel edges and, at times, several pieces."""
    return [(*sorted((r.randrange(n) * 3, r.randrange(n) * 3)), k, r.randint(1, far)) for k in range(m)]


def tables(edges):
    """Distances and numbers of shortest paths by relaxing all edges until nothing changes."""
    ids = sorted({x for e in edges for x in e[:2]})
    out = {}
    for s in ids:
        d = {s: 0}
        for _ in ids:
            for u, v, _, w in edges:
                for a, b in ((u, v), (v, u)):
                    if a in d and d[a] + w < d.get(b, math.inf):
                        d[b] = d[a] + w
        paths = {s: 1}
        for t in sorted(d, key=d.get):
            if t != s:
                paths[t] = sum(paths.get(a, 0) for u, v, _, w in edges if u != v for a, b in ((u, v), (v, u)) if b == t and a in d and d[a] + w == d[t])
        out[s] = d, paths
    return ids, out


def plain_vitality(edges):
    ids, full = tables(edges)
    if any(len(full[s][0]) < len(ids) for s in ids):
        return {v: math.nan for v in ids}
    out, whole = {}, sum(sum(full[s][0].values()) for s in ids) / 2
    for v in ids:
        rest = [e for e in edges if v not in e[:2]]
        others = [x for x in ids if x != v]
        _, left = tables(rest)
        cut = any(len(left[s][0]) < len(others) if s in left else len(others) > 1 for s in others)
        out[v] = -math.inf if cut else whole - sum(sum(left[s][0].values()) for s in others if s in left) / 2
    return out


def plain_shares(edges, meets):
    """The sum over ordered pairs of the share of shortest paths that meet the group, both ends outside of it."""
    ids, full = tables(edges)
    outside = [e for e in edges if not meets & set(e[:2])]
    total = 0.0
    for s in set(ids) - meets:
        d, paths = full[s]
        clear = {s: 1}
        for t in sorted(d, key=d.get):
            if t != s and t not in meets:
                clear[t] = sum(clear.get(a, 0) for u, v, _, w in outside if u != v for a, b in ((u, v), (v, u)) if b == t and a in d and d[a] + w == d[t])
        total += sum(1 - clear[t] / paths[t] for t in d if t != s and t not in meets)
    return total


@pytest.fixture(scope="module")
def networks():
    r = random.Random(5)
    return [network(r, n, m) for n, m in ((3, 2), (6, 5), (6, 14), (9, 11), (12, 40), (15, 22), (15, 30))] + [[(0, 0, 0, 1)], [(0, 3, 0, 2)], [(0, 3, 0, 2), (0, 3, 1, 2), (6, 6, 0, 1)]]


@pytest.fixture(scope="module")
def edges(spark, networks):
    return spark.createDataFrame([(k, *e) for k, n in enumerate(networks) for e in n], "network_id long, u long, v long, key long, w long")


@pytest.mark.parametrize("work", [walks.WORK, 40])
def test_nodes(edges, networks, monkeypatch, work):
    """However many parts a network has."""
    monkeypatch.setattr(walks, "WORK", work)
    got = {(r.network_id, r.id): r for r in graph.of_nodes(walks.walk(edges)).collect()}
    for k, n in enumerate(networks):
        ids, _ = tables(n)
        vital = plain_vitality(n)
        pairs = (len(ids) - 1) * (len(ids) - 2)
        for v in ids:
            r = got.pop((k, v))
            assert r.vc == pytest.approx(vital[v], nan_ok=True)
            assert r.betweenness_centrality == pytest.approx(plain_shares(n, {v}) / pairs if pairs > 0 else 0)
    assert not got


def test_edges(edges, networks):
    got = {tuple(r)[:4]: r.betweenness_centrality for r in graph.edge_betweenness(edges).collect()}
    for k, n in enumerate(networks):
        ids, full = tables(n)
        for u, v, key, w in n:
            over = sum(full[s][1][a] * full[b][1][t] / full[s][1][t] for s in ids for t in full[s][0] if s != t for a, b in ((u, v), (v, u)) if u != v and a in full[s][0] and t in full[b][0] and full[s][0][a] + w + full[b][0][t] == full[s][0][t])
            assert got[k, u, v, key] == (None if len(ids) < 2 else pytest.approx(over / (len(ids) * (len(ids) - 1))))


def test_groups(spark, edges, networks):
    r = random.Random(6)
    groups = [(k, g, r.sample(ids := tables(n)[0], min(len(ids), g)) + [999]) for k, n in enumerate(networks) for g in range(6)]
    frame = spark.createDataFrame(groups, "network_id long, group_id long, members array<long>")
    got = {(x.network_id, x.group_id): x.betweenness_centrality for x in graph.group_betweenness(edges, frame).collect()}
    for k, g, members in groups:
        ids = tables(networks[k])[0]
        others = len(set(ids) - set(members))
        want = plain_shares(networks[k], set(members) & set(ids)) / (others * (others - 1)) if others > 1 else 0
        assert got[k, g] == pytest.approx(want, abs=1e-9)


def test_katz(edges, networks):
    got = {(r.network_id, r.id): r.katz for r in graph.katz(edges, scale=100.0).collect()}
    for k, n in enumerate(networks):
        ids = tables(n)[0]
        a = np.zeros((len(ids), len(ids)))
        for u, v, _, w in sorted(n):
            i, j = ids.index(u), ids.index(v)
            a[i, j] = a[j, i] = w / 100
        x = np.linalg.solve(np.eye(len(ids)) - 0.1 * a, np.ones(len(ids)))
        assert [got[k, v] for v in ids] == pytest.approx((x / np.linalg.norm(x)).tolist(), abs=1e-12)


def test_no_edges(edges):
    none = edges.limit(0)
    assert graph.of_nodes(walks.walk(none)).isEmpty() and graph.katz(none).isEmpty() and walks.pair_table(none).isEmpty()


def test_fewer_steps_than_searches_without_each_node():
    """Repairing trees looks at the nodes behind the one that goes, not at all of them."""
    r = np.random.default_rng(1)
    n = 150
    u, v = np.concatenate([np.arange(1, n), r.integers(0, n, 200)]), np.concatenate([r.integers(0, np.arange(1, n)), r.integers(0, n, 200)])
    net = walks.Network(u, v, r.integers(1, 20, len(u)))
    behind = 0
    for s in range(net.size):
        order, _, _, last = net.tree(s)
        depth = {s: 0}
        for a in order[1:]:
            depth[a] = depth[last[a][0][0]] + 1
        behind += sum(depth.values())
    assert behind < net.size**3 / 15


def test_losses_as_weights(spark):
    e = spark.createDataFrame([(0, 1, 2, 0), (0, 2, 3, 0), (0, 3, 4, 0), (0, 4, 5, 0)], "network_id long, u long, v long, key long")
    lost = spark.createDataFrame([(0, 1, 2, 0, 1.26), (0, 2, 3, 0, 0.0), (0, 3, 4, 0, None), (0, 4, 5, 0, float("nan"))], "network_id long, u long, v long, key long, loss_percent double")
    assert sorted(r.w for r in graph.weighted(e, lost, 10.0).collect()) == [1, 13]
