"""DuckDB SQL that gives what the queries give, from the same tables."""

from __future__ import annotations

from gridspark.functions import fixed
from gridspark.plans import fixtures as fx


def _case(column: str, table: dict[str, object], default: str = "NULL") -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _list(values: object) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_KEY = "CASE WHEN n < 8 THEN 'node:' || n WHEN n < 12 THEN 'branch:(' || (n - 8) || ', ' || (n - 7) || ', 0)' WHEN n < 16 THEN 'child:' || n ELSE 'compound:' || n END"
_KIND = "CASE WHEN contains(node, 'CHP') OR contains(node, 'PowerToHeat') THEN 'compound' WHEN contains(node, '.child.') THEN 'child' WHEN ends_with(node, ')') THEN 'branch' ELSE 'node' END"
_UNIFORM = "(('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT / 4294967296.0)"


def _u(*key: str) -> str:
    return _UNIFORM.format(", ".join(f"({k})::VARCHAR" for k in key))


def _normal(mean: float, deviation: float, *key: str) -> str:
    return f"({mean} + {deviation} * sqrt(-2 * ln({_u(*key, '1')} + pow(2, -33))) * cos(2 * pi() * {_u(*key, '2')}))"


SQUARINGS = 25


def _extreme(name: str, cells: str) -> dict[str, str]:
    """The largest eigenvalue of a product of cells with itself (net, i, k, value): squared again and again, the product becomes the projection on its vector."""
    square = "SELECT net, x.i, x.j, value / sum(value) FILTER (x.i = x.j) OVER (PARTITION BY net) AS value FROM ({}) x"
    times = "SELECT a.net, a.i, b.i AS j, sum(a.value * b.value) AS value FROM {0} a JOIN {0} b ON a.net = b.net AND a.{1} = b.{1} GROUP BY ALL"
    return {
        f"{name}a": times.format(cells, "k"),
        f"{name}0": square.format(f"SELECT * FROM {name}a"),
        **{f"{name}{n + 1}": square.format(times.format(f"{name}{n}", "j")) for n in range(SQUARINGS)},
        f"{name}top": f"SELECT net, sum(a.value * b.value) AS top FROM {name}a a JOIN {name}{SQUARINGS} b USING (net, i, j) GROUP BY net",
    }


def _learning(i: int) -> dict[str, str]:
    """A round of expectation and maximisation: filtered, smoothed and new parameters."""
    gain, pull = "(p + q) / (p + q + r)", "CASE WHEN f.p + q = 0 THEN 0 ELSE f.p / (f.p + q) END"
    return {
        f"ef{i}": f"SELECT cp_density, t, n, q, r, m0 + p0 / (p0 + r) * (y - m0) AS m, r * p0 / (p0 + r) AS p FROM gser JOIN em{i} USING (cp_density) WHERE t = 0 UNION ALL SELECT k.cp_density, s.t, k.n, q, r, m + {gain} * (s.y - m), r * {gain} FROM ef{i} k JOIN gser s ON s.cp_density = k.cp_density AND s.t = k.t + 1",
        f"es{i}": f"SELECT cp_density, t, m AS mean, p AS var, NULL::DOUBLE AS change FROM ef{i} WHERE t = n - 1 UNION ALL SELECT cp_density, t, a, b, (mean - a) ** 2 + var + b - 2 * g * var FROM (SELECT k.cp_density, f.t, {pull} AS g, mean, var, f.m + g * (mean - f.m) AS a, f.p + g * g * (var - f.p - q) AS b FROM es{i} k JOIN ef{i} f ON f.cp_density = k.cp_density AND f.t = k.t - 1)",
        f"em{i + 1}": f"SELECT s.cp_density, coalesce(avg(change), any_value(q)) AS q, avg((y - mean) ** 2 + var) AS r, max(mean) FILTER (s.t = 0) AS m0, max(var) FILTER (s.t = 0) AS p0 FROM es{i} s JOIN gser g ON g.cp_density = s.cp_density AND g.t = s.t JOIN em{i} e ON e.cp_density = s.cp_density GROUP BY s.cp_density",
    }


def _sensitivities(p: str) -> dict[str, str]:
    """Admittances, powers, derivatives, their inverse (one bus variable after the other is swept out) and flow changes of networks whose slack is bus 0."""
    return {
        f"{p}y": f"SELECT net, i, j, sum(re) AS re, sum(im) AS im FROM (SELECT net, f AS i, t AS j, -(g * cos(sh) - b * sin(sh)) / a AS re, -(g * sin(sh) + b * cos(sh)) / a AS im FROM {p}pi UNION ALL SELECT net, t, f, -(g * cos(sh) + b * sin(sh)) / a, -(b * cos(sh) - g * sin(sh)) / a FROM {p}pi UNION ALL SELECT net, f, f, g / (a * a), b / (a * a) + 0.01 FROM {p}pi UNION ALL SELECT net, t, t, g, b + 0.01 FROM {p}pi) GROUP BY ALL",
        f"{p}pair": f"SELECT y.*, m.v AS vi, n.v AS vj, re * cos(m.th - n.th) + im * sin(m.th - n.th) AS al, re * sin(m.th - n.th) - im * cos(m.th - n.th) AS ac FROM {p}y y JOIN {p}bus m ON m.net = y.net AND m.i = y.i JOIN {p}bus n ON n.net = y.net AND n.i = y.j",
        f"{p}pq": f"SELECT net, i, sum(vi * vj * al) AS p, sum(vi * vj * ac) AS q FROM {p}pair GROUP BY ALL",
        f"{p}jac": f"SELECT net, 2 * i + dr AS r, 2 * j + dc AS c, value FROM (SELECT net, i, j, unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc, unnest([vi * vj * ac, vi * al, -vi * vj * al, vi * ac]) AS value FROM {p}pair WHERE i <> j UNION ALL SELECT net, i, j, unnest([0, 0, 1, 1]), unnest([0, 1, 0, 1]), unnest([-q - im * vi * vi, p / vi + re * vi, p - re * vi * vi, q / vi - im * vi]) FROM {p}pair JOIN {p}pq USING (net, i) WHERE i = j) WHERE i > 0 AND j > 0",
        f"{p}state": f"SELECT net, r, row_number() OVER (PARTITION BY net ORDER BY r) AS k, count(*) OVER (PARTITION BY net) AS n FROM (SELECT DISTINCT net, r FROM {p}jac)",
        f"{p}sweep": f"SELECT x.net, 0::BIGINT AS k, x.n, x.r, y.r AS c, coalesce(value, 0) AS value FROM {p}state x JOIN {p}state y ON x.net = y.net LEFT JOIN {p}jac j ON j.net = x.net AND j.r = x.r AND j.c = y.r UNION ALL SELECT x.net, s.k, x.n, x.r, x.c, CASE WHEN x.r = s.r AND x.c = s.r THEN 1 / d.value WHEN x.r = s.r THEN x.value / d.value WHEN x.c = s.r THEN -x.value / d.value ELSE x.value - a.value * b.value / d.value END FROM {p}sweep x JOIN {p}state s ON s.net = x.net AND s.k = x.k + 1 JOIN {p}sweep a ON a.net = x.net AND a.r = x.r AND a.c = s.r JOIN {p}sweep b ON b.net = x.net AND b.r = s.r AND b.c = x.c JOIN {p}sweep d ON d.net = x.net AND d.r = s.r AND d.c = s.r",
        f"{p}inverse": f"SELECT net, r AS state, c AS r, value FROM {p}sweep WHERE k = n",
        f"{p}dx": f"SELECT t.net, t.s, t.t, state, sum(CASE WHEN r = 2 * s THEN value ELSE 0 END - CASE WHEN r = 2 * t THEN value ELSE 0 END) AS dx FROM {p}tr t JOIN {p}inverse i USING (net) GROUP BY ALL",
        f"{p}turn": f"SELECT e.net, branch, e.f, e.t, m.v AS vi, n.v AS vj, a, g, g * cos(m.th - n.th - sh) + b * sin(m.th - n.th - sh) AS turn, -m.v * n.v / a * (b * cos(m.th - n.th - sh) - g * sin(m.th - n.th - sh)) AS slope FROM {p}pi e JOIN {p}bus m ON m.net = e.net AND m.i = e.f JOIN {p}bus n ON n.net = e.net AND n.i = e.t",
        f"{p}flow": f"SELECT net, s, t, branch, sum(w * dx) AS ptdf FROM (SELECT net, branch, unnest([2 * f, 2 * t, 2 * f + 1, 2 * t + 1]) AS state, unnest([slope, -slope, 2 * vi * g / (a * a) - vj / a * turn, -vi / a * turn]) AS w FROM {p}turn) JOIN {p}dx USING (net, state) GROUP BY ALL",
    }


_PARTS = {
    "run": f"SELECT event_id, event_type, value, user_id AS id, CAST(day(ts) AS BIGINT) - 1 AS step, CAST((user_id % 5) * 0.5 AS DOUBLE) AS cp_density, 'data/res/net-' || {_list(fx.LABELS)}[user_id % 3 + 1] || '-' || CAST(CAST((user_id % 5) * 0.5 AS DOUBLE) AS VARCHAR) AS experiment FROM events",
    "perf": "SELECT cp_density, experiment, id, step, " + ", ".join(f"coalesce(sum(CASE WHEN event_type = '{k}' THEN CAST(round(value * 100) AS BIGINT) END), 0)::BIGINT AS c{i}" for i, k in enumerate(("click", "view", "signup"))) + " FROM run WHERE event_type IN ('click', 'view', 'signup') GROUP BY ALL",
    "faults": "SELECT event_id, cp_density, experiment, id, step, CASE event_type WHEN 'error' THEN 'failure' ELSE 'repair' END AS type, event_id % 20 AS n, CASE WHEN n < 8 THEN 'b:Bus:' || n WHEN n < 12 THEN 'l:PowerLine:(' || (n - 8) || ', ' || (n - 7) || ', 0)' WHEN n < 16 THEN 'x.child.1:PowerLoad:' || n ELSE 'c:CHP:' || n END AS node FROM run WHERE event_type IN ('error', 'purchase')",
    "keyed": f"SELECT * REPLACE ({_KIND} || ':' || split_part(node, ':', -1) AS node) FROM faults",
    "pairs": "SELECT cp_density, experiment, id, node, min(step) FILTER (type = 'failure') AS failed, min(step) FILTER (type = 'repair') AS repaired FROM keyed GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (type = 'failure') = 1",
    "inside": "SELECT p.*, q.node FROM perf p JOIN pairs q ON p.cp_density = q.cp_density AND p.experiment = q.experiment AND p.id = q.id AND p.step BETWEEN q.failed AND q.repaired",
    "comp": f"SELECT {_KEY} AS node, {_list(fx.TYPES)}[n + 1] AS type, unnest([0.0, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS cp_density FROM range(20) t(n)",
    "outside": "SELECT c.node, p.* FROM comp c JOIN perf p USING (cp_density) WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.cp_density = p.cp_density AND q.experiment = p.experiment AND q.id = p.id AND q.node = c.node AND p.step BETWEEN q.failed AND q.repaired)",
    "long": "SELECT cp_density, node, type, carrier, i, o FROM (SELECT c.cp_density, c.node, c.type, unnest(['electricity', 'heat', 'gas']) AS carrier, unnest([i0, i1, i2]) AS i, unnest([o0, o1, o2]) AS o FROM comp c LEFT JOIN (SELECT cp_density, node, sum(c0) / (count(*) * 100.0::DOUBLE) AS i0, sum(c1) / (count(*) * 100.0::DOUBLE) AS i1, sum(c2) / (count(*) * 100.0::DOUBLE) AS i2 FROM inside GROUP BY ALL) a USING (cp_density, node) LEFT JOIN (SELECT cp_density, node, sum(c0) / (count(*) * 100.0::DOUBLE) AS o0, sum(c1) / (count(*) * 100.0::DOUBLE) AS o1, sum(c2) / (count(*) * 100.0::DOUBLE) AS o2 FROM outside GROUP BY ALL) b USING (cp_density, node))",
    "impact": "SELECT cp_density, node, type, carrier, CASE WHEN i > o THEN (i + 1e-11::DOUBLE) / (o + 1e-11::DOUBLE) ELSE -(o + 1e-11::DOUBLE) / (i + 1e-11::DOUBLE) END AS impact FROM long",
    "milli": f"SELECT cp_density, node, type, carrier, CAST(round(impact * 1000) AS BIGINT) AS impact, {_case('type', fixed.CARRIER, chr(39) + 'unknown' + chr(39))} AS type_carrier FROM impact",
    "members": "SELECT cp_density, node AS child, 'node:' || (CAST(split_part(node, ':', 2) AS INT) % 2) AS node, 'Bus' AS type FROM comp WHERE node LIKE 'child:%'",
    "children": "SELECT m.cp_density, m.node, m.type, i.carrier, sum(i.impact) / count(i.impact)::DOUBLE AS impact FROM members m JOIN milli i ON i.cp_density = m.cp_density AND i.node = m.child GROUP BY ALL",
    "edges": "SELECT u, v, min(w) AS w FROM (SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(floor(d * 1000 / n) AS BIGINT) + 1 AS w FROM (SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, count(*) AS n, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) WHERE r <= 2) GROUP BY ALL",
    "nodes": "SELECT u AS id FROM edges UNION SELECT v FROM edges",
    "arcs": "SELECT u AS a, v AS b, w FROM edges UNION ALL SELECT v, u, w FROM edges",
    "d0": "SELECT s.id AS s, t.id AS t, min(CASE WHEN s.id = t.id THEN 0 ELSE w END) AS d FROM nodes s, nodes t LEFT JOIN arcs ON a = s.id AND b = t.id GROUP BY ALL",
    **{f"d{k}": f"SELECT x.s, y.t, min(x.d + y.d) AS d FROM d{k - 1} x JOIN d{k - 1} y ON x.t = y.s GROUP BY ALL" for k in range(1, 6)},
    "dist": "SELECT s, t, CAST(d AS BIGINT) AS d FROM d5 WHERE d IS NOT NULL",
    "walk": "SELECT id AS s, id AS v FROM nodes UNION ALL SELECT k.s, e.b FROM walk k JOIN arcs e ON e.a = k.v JOIN dist p ON p.s = k.s AND p.t = k.v JOIN dist q ON q.s = k.s AND q.t = e.b WHERE q.d = p.d + e.w",
    "sigma": "SELECT s, v, count(*)::DOUBLE AS n FROM walk GROUP BY ALL",
    "st": "SELECT d.s, d.t, d.d, g.n FROM dist d JOIN sigma g ON g.s = d.s AND g.v = d.t WHERE d.s < d.t",
    "deg": "SELECT id, count(*) AS degree FROM (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) GROUP BY ALL",
    "bc": "SELECT n.id, coalesce(x, 0) * 2 / ((c - 1) * (c - 2)) AS bc FROM nodes n CROSS JOIN (SELECT count(*) AS c FROM nodes) LEFT JOIN (SELECT a.t AS id, sum(ga.n * gb.n / st.n) AS x FROM st JOIN dist a ON a.s = st.s JOIN dist b ON b.s = a.t AND b.t = st.t JOIN sigma ga ON ga.s = st.s AND ga.v = a.t JOIN sigma gb ON gb.s = a.t AND gb.v = st.t WHERE a.d + b.d = st.d AND a.t NOT IN (st.s, st.t) GROUP BY ALL) USING (id)",
    "ebc": "SELECT e.u, e.v, coalesce(x, 0) * 2 / (c * (c - 1)) AS bc FROM edges e CROSS JOIN (SELECT count(*) AS c FROM nodes) LEFT JOIN (SELECT least(e.a, e.b) AS u, greatest(e.a, e.b) AS v, sum(ga.n * gb.n / st.n) AS x FROM st JOIN arcs e ON true JOIN dist a ON a.s = st.s AND a.t = e.a JOIN dist b ON b.s = e.b AND b.t = st.t JOIN sigma ga ON ga.s = st.s AND ga.v = e.a JOIN sigma gb ON gb.s = e.b AND gb.v = st.t WHERE a.d + e.w + b.d = st.d GROUP BY ALL) USING (u, v)",
    "r0": "SELECT r.id AS r, d0.* FROM nodes r, d0 WHERE r.id NOT IN (s, t)",
    **{f"r{k}": f"SELECT x.r, x.s, y.t, min(x.d + y.d) AS d FROM r{k - 1} x JOIN r{k - 1} y ON x.t = y.s AND x.r = y.r GROUP BY ALL" for k in range(1, 6)},
    "vit": "SELECT r AS id, CASE WHEN bool_or(d IS NULL) THEN '-inf'::DOUBLE ELSE (SELECT sum(d) / 2.0 FROM dist) - sum(d) / 2.0 END AS vc FROM r5 GROUP BY ALL",
    "k0": "SELECT id, 1.0::DOUBLE AS x FROM nodes",
    **{f"k{k}": f"SELECT n.id, 1 + 0.1 * sum(w / 100000.0 * x) AS x FROM nodes n JOIN arcs ON a = n.id JOIN k{k - 1} p ON p.id = b GROUP BY ALL" for k in range(1, 16)},
    "kz": "SELECT id, x / sqrt(sum(x * x) OVER ()) AS katz FROM k15",
    "grp": "SELECT unnest([1, 2]) AS id, unnest(['CHP', 'PowerToHeat']) AS type, unnest([[1, 2], [3, 4, 5]]) AS m",
    "clear": "SELECT grp.id AS g, n.id AS s, n.id AS v FROM nodes n, grp WHERE NOT list_contains(m, n.id) UNION ALL SELECT k.g, k.s, e.b FROM clear k JOIN grp ON grp.id = k.g JOIN arcs e ON e.a = k.v JOIN dist p ON p.s = k.s AND p.t = k.v JOIN dist q ON q.s = k.s AND q.t = e.b WHERE q.d = p.d + e.w AND NOT list_contains(m, e.b)",
    "gbc": "SELECT grp.id AS group_id, sum(1 - coalesce(c.n, 0) / st.n) / count(*) AS bc FROM grp JOIN st ON NOT list_contains(m, st.s) AND NOT list_contains(m, st.t) LEFT JOIN (SELECT g, s, v, count(*)::DOUBLE AS n FROM clear GROUP BY ALL) c ON c.g = grp.id AND c.s = st.s AND c.v = st.t GROUP BY ALL",
    "sup": "SELECT s_suppkey::BIGINT AS id, n_regionkey::BIGINT AS net, s_nationkey::BIGINT AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "medges": "SELECT net, least(a, b) AS u, greatest(a, b) AS v, CASE WHEN a < b THEN 0 ELSE 1 END::BIGINT AS key, 1 + n % 50 AS w FROM (SELECT x.net, x.id AS a, y.id AS b, count(*) AS n, row_number() OVER (PARTITION BY x.net, x.id ORDER BY count(*) DESC, y.id) AS r FROM (SELECT DISTINCT l_partkey AS p, net, id FROM lineitem JOIN sup ON id = l_suppkey) x JOIN (SELECT DISTINCT l_partkey AS p, net, id FROM lineitem JOIN sup ON id = l_suppkey) y ON x.p = y.p AND x.net = y.net AND x.id <> y.id GROUP BY 1, 2, 3) WHERE r <= 2",
    "mnodes": "SELECT net, u AS id FROM medges UNION SELECT net, v FROM medges",
    "marcs": "SELECT net, u AS a, v AS b, u, v, key, w FROM medges UNION ALL SELECT net, v, u, u, v, key, w FROM medges",
    "md0": "SELECT s.net, s.id AS s, t.id AS t, min(CASE WHEN s.id = t.id THEN 0 ELSE w END) AS d FROM mnodes s JOIN mnodes t ON s.net = t.net LEFT JOIN marcs ON a = s.id AND b = t.id GROUP BY ALL",
    **{f"md{k}": f"SELECT x.net, x.s, y.t, min(x.d + y.d) AS d FROM md{k - 1} x JOIN md{k - 1} y ON x.t = y.s AND x.net = y.net GROUP BY ALL" for k in range(1, 6)},
    "mdist": "SELECT net, s, t, CAST(d AS BIGINT) AS d FROM md5 WHERE d IS NOT NULL",
    "mwalk": "SELECT net, id AS s, id AS v FROM mnodes UNION ALL SELECT k.net, k.s, e.b FROM mwalk k JOIN marcs e ON e.a = k.v JOIN mdist p ON p.s = k.s AND p.t = k.v JOIN mdist q ON q.s = k.s AND q.t = e.b WHERE q.d = p.d + e.w",
    "msigma": "SELECT net, s, v, count(*)::DOUBLE AS n FROM mwalk GROUP BY ALL",
    "mst": "SELECT d.net, d.s, d.t, d.d, g.n FROM mdist d JOIN msigma g ON g.s = d.s AND g.v = d.t WHERE d.s < d.t",
    "msize": "SELECT net, count(*) AS c FROM mnodes GROUP BY net",
    "mdeg": "SELECT net, a AS id, count(*) AS degree FROM marcs GROUP BY ALL",
    "mbc": "SELECT n.net, n.id, CASE WHEN c > 2 THEN coalesce(x, 0) * 2 / ((c - 1) * (c - 2)) ELSE 0 END AS bc FROM mnodes n JOIN msize USING (net) LEFT JOIN (SELECT a.t AS id, sum(ga.n * gb.n / mst.n) AS x FROM mst JOIN mdist a ON a.s = mst.s JOIN mdist b ON b.s = a.t AND b.t = mst.t JOIN msigma ga ON ga.s = mst.s AND ga.v = a.t JOIN msigma gb ON gb.s = a.t AND gb.v = mst.t WHERE a.d + b.d = mst.d AND a.t NOT IN (mst.s, mst.t) GROUP BY ALL) USING (id)",
    "mebc": "SELECT e.net, e.u, e.v, e.key, coalesce(x, 0) * 2 / (c * (c - 1)) AS bc FROM medges e JOIN msize USING (net) LEFT JOIN (SELECT e.u, e.v, e.key, sum(ga.n * gb.n / mst.n) AS x FROM mst JOIN marcs e ON e.net = mst.net JOIN mdist a ON a.s = mst.s AND a.t = e.a JOIN mdist b ON b.s = e.b AND b.t = mst.t JOIN msigma ga ON ga.s = mst.s AND ga.v = e.a JOIN msigma gb ON gb.s = e.b AND gb.v = mst.t WHERE a.d + e.w + b.d = mst.d GROUP BY ALL) USING (u, v, key)",
    "mr0": "SELECT r.id AS r, md0.* FROM mnodes r JOIN md0 ON r.net = md0.net WHERE r.id NOT IN (s, t)",
    **{f"mr{k}": f"SELECT x.r, x.net, x.s, y.t, min(x.d + y.d) AS d FROM mr{k - 1} x JOIN mr{k - 1} y ON x.t = y.s AND x.r = y.r GROUP BY ALL" for k in range(1, 6)},
    "mvit": "SELECT n.net, n.id, CASE WHEN (SELECT count(*) FROM mdist m WHERE m.net = n.net) < c * c THEN 'nan'::DOUBLE WHEN cut THEN '-inf'::DOUBLE ELSE (SELECT sum(d) / 2.0 FROM mdist m WHERE m.net = n.net) - coalesce(rest, 0) END AS vc FROM mnodes n JOIN msize USING (net) LEFT JOIN (SELECT r AS id, bool_or(d IS NULL) AS cut, sum(d) / 2.0 AS rest FROM mr5 GROUP BY ALL) USING (id)",
    "msimple": "SELECT net, a, b, arg_max(w, key) / 5000.0::DOUBLE AS w FROM marcs GROUP BY ALL",
    "mk0": "SELECT id, 1.0::DOUBLE AS x FROM mnodes",
    **{f"mk{k}": f"SELECT a AS id, 1 + 0.1 * sum(w * x) AS x FROM msimple JOIN mk{k - 1} p ON p.id = b GROUP BY ALL" for k in range(1, 25)},
    "mkz": "SELECT net, id, x / sqrt(sum(x * x) OVER (PARTITION BY net)) AS katz FROM mk24 JOIN mnodes USING (id)",
    "mgrp": "SELECT nation AS id, net, list(id) AS m, min(id) AS first, max(id) AS last FROM sup GROUP BY ALL",
    "mclear": "SELECT mgrp.id AS g, n.net, n.id AS s, n.id AS v FROM mnodes n JOIN mgrp ON n.net = mgrp.net WHERE NOT list_contains(m, n.id) UNION ALL SELECT k.g, k.net, k.s, e.b FROM mclear k JOIN mgrp ON mgrp.id = k.g JOIN marcs e ON e.a = k.v JOIN mdist p ON p.s = k.s AND p.t = k.v JOIN mdist q ON q.s = k.s AND q.t = e.b WHERE q.d = p.d + e.w AND NOT list_contains(m, e.b)",
    "mgbc": "SELECT g.net, g.id AS group_id, CASE WHEN o > 1 THEN coalesce(x, 0) * 2 / (o * (o - 1)) ELSE 0 END AS bc FROM (SELECT mgrp.net, mgrp.id, count(*) FILTER (NOT list_contains(m, n.id)) AS o FROM mgrp JOIN mnodes n ON n.net = mgrp.net GROUP BY ALL) g LEFT JOIN (SELECT mgrp.id, sum(1 - coalesce(c.n, 0) / mst.n) AS x FROM mgrp JOIN mst ON mst.net = mgrp.net AND NOT list_contains(m, mst.s) AND NOT list_contains(m, mst.t) LEFT JOIN (SELECT g, s, v, count(*)::DOUBLE AS n FROM mclear GROUP BY ALL) c ON c.g = mgrp.id AND c.s = mst.s AND c.v = mst.t GROUP BY ALL) USING (id)",
    "mall": "SELECT net, id, degree, bc, vc, katz FROM mdeg JOIN mbc USING (net, id) JOIN mvit USING (net, id) JOIN mkz USING (net, id)",
    "pi": "SELECT u AS f, v AS t, u * 100 + v AS branch, w / 100000.0::DOUBLE AS r, w / 20000.0::DOUBLE AS x, CASE WHEN u % 3 = 0 THEN 1.0 ELSE 0.98 END::DOUBLE AS a, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS b, 1.0 + (u % 5) / 100.0::DOUBLE AS vi, 1.0 + (v % 5) / 100.0::DOUBLE AS vj, (u % 7) / 100.0::DOUBLE - (v % 7) / 100.0::DOUBLE AS dth FROM edges",
    "gbus": "SELECT net, row_number() OVER (PARTITION BY net ORDER BY id) - 1 AS i, id, nation, (id % 7) / 100.0::DOUBLE AS th, 1.0 + (id % 5) / 100.0::DOUBLE AS v FROM mnodes JOIN sup USING (net, id)",
    "gpi": "SELECT e.net, f.i AS f, t.i AS t, (u * 100000 + e.v) * 2 + key AS branch, w / 10000.0::DOUBLE AS r, w / 2000.0::DOUBLE AS x, CASE WHEN u % 3 = 0 THEN 1.0 ELSE 0.98 END::DOUBLE AS a, (w % 3) / 100.0::DOUBLE AS sh, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS b FROM medges e JOIN gbus f ON f.net = e.net AND f.id = u JOIN gbus t ON t.net = e.net AND t.id = e.v",
    "nbus": "SELECT 0 AS net, id AS i, (id % 7) / 100.0::DOUBLE AS th, 1.0 + (id % 5) / 100.0::DOUBLE AS v FROM nodes",
    "npi": "SELECT 0 AS net, f, t, branch, a, 0.0::DOUBLE AS sh, g, b FROM pi",
    "ntr": "SELECT * FROM (VALUES (0, 1, 2), (0, 3, 0)) v(net, s, t)",
    **{k: v for p in "gn" for k, v in _sensitivities(p).items()},
    "gcol": "SELECT net, c AS i, r AS k, value FROM gjac",
    "ginv": "SELECT net, state AS i, r AS k, value FROM ginverse",
    **_extreme("gl", "gcol"),
    **_extreme("gs", "ginv"),
    "gtr": "SELECT net, s.i AS s, t.i AS t FROM gbus s JOIN (SELECT net, nation, min(i) AS i FROM gbus GROUP BY ALL) t USING (net) WHERE s.i <> t.i",
    "parts": f"SELECT p_partkey AS component_id, CASE p_partkey % 5 WHEN 2 THEN 'branch' WHEN 3 THEN 'child' WHEN 4 THEN 'compound' ELSE 'node' END AS kind, {_case('p_type', fx.PART_TYPES)} AS type, CASE p_partkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'gas' WHEN 2 THEN 'water' END AS grid, p_partkey % 6 <> 0 AS independent, p_size / 10.0::DOUBLE AS coefficient, p_retailprice AS nominal FROM part",
    "own": "SELECT * FROM parts WHERE independent OR kind = 'compound' OR (kind = 'branch' AND type = 'HeatExchanger')",
    "trial": f"SELECT own.*, run_id, i, i::INT AS time, {_case('type', fixed.BASE_FAILURE, '0.0')}::DOUBLE * {_normal(1.0, 0.1, '101', 'run_id', 'i', 'component_id', chr(39) + 'p' + chr(39))} * 50 * exp(-((i - 1.5) * (i - 1.5)) / 2) / sqrt(2 * pi()) * 0.3 AS p FROM own, range(3) r(run_id), range(3) s(i)",
    "fail": f"SELECT * FROM trial WHERE {_u('101', 'run_id', 'i', 'component_id', chr(39) + 'u' + chr(39))} < p",
    "rep": f"SELECT *, CASE WHEN type = 'Trafo' THEN 1.0 ELSE coefficient END * {_normal(1.0, 0.1, '101', 'run_id', 'time', 'component_id', chr(39) + 'd' + chr(39))} * p AS damage, CAST(trunc(time + greatest({_normal(5.0, 5.0, '101', 'run_id', 'time', 'component_id', chr(39) + 'r' + chr(39))} + 5 + damage / 10, 3.0)) AS INT) AS repaired_time FROM fail",
    "log": "SELECT run_id, component_id, kind || '-' || component_id || ':' || type || ':' || component_id AS node, unnest([time, repaired_time]) AS step, unnest(['failure', 'repair']) AS type FROM rep",
    "hourly": "SELECT o_orderstatus AS profile, datediff('day', (SELECT min(o_orderdate::DATE) FROM orders), o_orderdate::DATE) AS hour, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS kw FROM orders GROUP BY ALL",
    "metrics": "SELECT node, cp_density, type AS type_y, " + ", ".join(f"((h // {k}) % 1000)::DOUBLE AS {m}" for m, k in {"betweenness_centrality": 1, "degree": 7, "vc": 49, "katz": 343}.items()) + " FROM (SELECT *, ('0x' || substr(md5(node || '|' || cp_density::VARCHAR), 1, 8))::BIGINT AS h FROM comp)",
    "joined": "SELECT i.node, i.cp_density, i.carrier, i.impact, m.type_y, m.betweenness_centrality, m.degree, m.vc, m.katz FROM milli i JOIN metrics m ON m.node = i.node AND m.cp_density = i.cp_density WHERE impact IS NOT NULL",
    "groups": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}')" for g, types in fixed.TYPE_GROUPS.items() for t in types) + ") v(type_group, type_y)",
    "framed": "SELECT *, 'all' AS type_group FROM joined UNION ALL BY NAME SELECT joined.*, type_group FROM joined JOIN groups USING (type_y)",
    "states": "SELECT id, node, step::INT AS step, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY id, node ORDER BY step), 1) = 1 AS active FROM (SELECT DISTINCT id, node FROM moves) CROSS JOIN range(30) r(step) LEFT JOIN (SELECT id, node, step, max_by(kind, position) AS kind FROM moves WHERE step < 30 GROUP BY ALL) USING (id, node, step)",
    "moves": "SELECT id, node, step::INT AS step, event_id AS position, CASE type WHEN 'failure' THEN 0 ELSE 1 END AS kind FROM faults",
    "kser": "SELECT cp_density, row_number() OVER (PARTITION BY cp_density ORDER BY id, experiment) - 1 AS t, count(*) OVER (PARTITION BY cp_density) - 1 AS e, total / 10000.0::DOUBLE AS y FROM total",
    "kfil": "SELECT cp_density, t, e, 0.0 + 1.0::DOUBLE / 3 * y AS m, 2.0::DOUBLE / 3 AS p FROM kser WHERE t = 0 UNION ALL SELECT k.cp_density, s.t, k.e, m + (p + 0.5) / (p + 2.5) * (y - m), 2 * (p + 0.5) / (p + 2.5) FROM kfil k JOIN kser s ON s.cp_density = k.cp_density AND s.t = k.t + 1",
    "ksmo": "SELECT cp_density, t, m AS mean, p AS var, NULL::DOUBLE AS change FROM kfil WHERE t = e UNION ALL SELECT k.cp_density, f.t, f.m + f.p / (f.p + 0.5) * (mean - f.m), f.p + (f.p / (f.p + 0.5)) ** 2 * (var - f.p - 0.5), (f.m + f.p / (f.p + 0.5) * (mean - f.m) - mean) ** 2 + var + f.p + (f.p / (f.p + 0.5)) ** 2 * (var - f.p - 0.5) - 2 * f.p / (f.p + 0.5) * var FROM ksmo k JOIN kfil f ON f.cp_density = k.cp_density AND f.t = k.t - 1",
    "gser": "SELECT cp_density, t, CASE WHEN t = 0 THEN 1.0 ELSE last_value(CASE WHEN t < 100 THEN v END IGNORE NULLS) OVER (PARTITION BY cp_density ORDER BY t) END::DOUBLE AS y, count(*) OVER (PARTITION BY cp_density) AS n FROM (SELECT cp_density, row_number() OVER w - 1 AS t, var_pop(total) OVER (w ROWS UNBOUNDED PRECEDING) / 10 AS v FROM total WINDOW w AS (PARTITION BY cp_density ORDER BY id))",
    "em0": "SELECT DISTINCT cp_density, 0.0::DOUBLE AS q, 1.0::DOUBLE AS r, 0.0::DOUBLE AS m0, 1.0::DOUBLE AS p0 FROM gser",
    **{k: v for i in range(10) for k, v in _learning(i).items()},
    "total": "SELECT cp_density, experiment, id, sum(c0 + c1 + c2)::BIGINT AS total FROM perf GROUP BY ALL",
}
_RECURSIVE = {"walk", "clear", "mwalk", "mclear", "gsweep", "nsweep", "kfil", "ksmo", *(f"e{x}{i}" for x in "fs" for i in range(10))}
_NEEDS = {
    "perf": ["run"], "faults": ["run"], "keyed": ["faults"], "pairs": ["keyed"], "inside": ["perf", "pairs"], "outside": ["comp", "perf", "pairs"], "long": ["comp", "inside", "outside"], "impact": ["long"], "milli": ["impact"], "members": ["comp"], "children": ["members", "milli"],
    "nodes": ["edges"], "arcs": ["edges"], "d0": ["nodes", "arcs"], **{f"d{k}": [f"d{k - 1}"] for k in range(1, 6)}, "dist": ["d5"], "walk": ["nodes", "arcs", "dist"], "sigma": ["walk"], "st": ["dist", "sigma"], "deg": ["edges"], "bc": ["nodes", "st"], "ebc": ["edges", "nodes", "arcs", "st"], "r0": ["nodes", "d0"], **{f"r{k}": [f"r{k - 1}"] for k in range(1, 6)}, "vit": ["r5", "dist"], "k0": ["nodes"], **{f"k{k}": [f"k{k - 1}", "arcs"] for k in range(1, 16)}, "kz": ["k15"], "clear": ["nodes", "grp", "arcs", "dist"], "gbc": ["grp", "st", "clear"],
    "medges": ["sup"], "mnodes": ["medges"], "marcs": ["medges"], "md0": ["mnodes", "marcs"], **{f"md{k}": [f"md{k - 1}"] for k in range(1, 6)}, "mdist": ["md5"], "mwalk": ["mnodes", "marcs", "mdist"], "msigma": ["mwalk"], "mst": ["mdist", "msigma"], "msize": ["mnodes"], "mdeg": ["marcs"], "mbc": ["msize", "mst"], "mebc": ["msize", "marcs", "mst"], "mr0": ["mnodes", "md0"], **{f"mr{k}": [f"mr{k - 1}"] for k in range(1, 6)}, "mvit": ["msize", "mr5", "mdist"], "msimple": ["marcs"], "mk0": ["mnodes"], **{f"mk{k}": [f"mk{k - 1}", "msimple"] for k in range(1, 25)}, "mkz": ["mk24", "mnodes"], "mgrp": ["sup"], "mclear": ["mgrp", "mnodes", "marcs", "mdist"], "mgbc": ["mgrp", "mst", "mclear"], "gbus": ["mnodes", "sup"], "gpi": ["medges", "gbus"], "gcol": ["gjac"], "ginv": ["ginverse"], **{k: v for n, cells in (("gl", "gcol"), ("gs", "ginv")) for k, v in {f"{n}a": [cells], f"{n}0": [f"{n}a"], **{f"{n}{i + 1}": [f"{n}{i}"] for i in range(SQUARINGS)}, f"{n}top": [f"{n}a", f"{n}{SQUARINGS}"]}.items()}, "gtr": ["gbus"], "nbus": ["nodes"], "npi": ["pi"], **{p + k: [p + x for x in v] for p in "gn" for k, v in {"y": ["pi"], "pair": ["y", "bus"], "pq": ["pair"], "jac": ["pair", "pq"], "state": ["jac"], "sweep": ["state"], "inverse": ["sweep"], "dx": ["tr", "inverse"], "turn": ["pi", "bus"], "flow": ["turn", "dx"]}.items()}, "mall": ["mdeg", "mbc", "mvit", "mkz"],
    "pi": ["edges"], "own": ["parts"], "trial": ["own"], "fail": ["trial"], "rep": ["fail"], "log": ["rep"], "metrics": ["comp"], "joined": ["milli", "metrics"], "framed": ["joined", "groups"], "moves": ["faults"], "states": ["moves"], "total": ["perf"], "kser": ["total"], "kfil": ["kser"], "ksmo": ["kfil"], "gser": ["total"], "em0": ["gser"], **{k: v for i in range(10) for k, v in {f"ef{i}": [f"em{i}", "gser"], f"es{i}": [f"ef{i}"], f"em{i + 1}": [f"es{i}", "gser", f"em{i}"]}.items()},
}


def _sql(body: str, *parts: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    named = ", ".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({_PARTS[n]})" for n in order)
    return (f"WITH RECURSIVE {named} " if order else "") + body


ORACLES: dict[str, str] = {
    "scan_annotate": _sql("SELECT DISTINCT experiment, id, split_part(split_part(experiment, '/', 3), '-', 2) AS power_impact, split_part(split_part(experiment, '/', 3), '-', 3) AS heat_impact, split_part(split_part(experiment, '/', 3), '-', 4) AS gas_impact, split_part(split_part(experiment, '/', 3), '-', 5) AS mes_impact, cp_density FROM perf", "perf"),
    "folder_scan": _sql("SELECT replace(experiment, 'data/res/', 'data/results/') AS experiment, split_part(experiment, '-', 3) AS heat_impact, cp_density, count(*) AS n, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1, sum(c2)::BIGINT AS c2 FROM perf WHERE cp_density >= 1 AND split_part(experiment, '-', 2) <> '5' GROUP BY ALL", "perf"),
    "folder_faults": _sql("SELECT cp_density, id, node, failed, repaired FROM pairs", "pairs"),
    "component_key": _sql(f"SELECT DISTINCT node, {_KIND} AS kind, {_KIND} || ':' || split_part(node, ':', -1) AS key FROM faults WHERE type = 'failure'", "faults"),
    "failure_repair_pairs": _sql("SELECT * FROM pairs", "pairs"),
    "interval_inside": _sql("SELECT * FROM inside", "inside"),
    "interval_outside": _sql("SELECT cp_density, node, count(*) AS n, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1, sum(c2)::BIGINT AS c2 FROM outside GROUP BY ALL", "outside"),
    "impact_subtraction": _sql("SELECT * FROM impact", "impact"),
    "interval_sums": _sql("SELECT cp_density, pairs.node, " + ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS in_s_{c}, count({c}) AS in_n_{c}" for c in ("c0", "c1", "c2")) + " FROM pairs LEFT JOIN inside USING (cp_density, experiment, id, node) WHERE failed <= repaired GROUP BY ALL", "pairs", "inside"),
    "impact_running": _sql("SELECT * FROM impact", "impact"),
    "impact_naive": _sql("SELECT cp_density, node, impact FROM impact WHERE carrier = 'electricity'", "impact"),
    "scenario_resilience": _sql(f"SELECT cp_density, x AS experiment, {_case('x', fixed.SCENARIO, 'x')} AS scenario, id, carrier, resilience_mean FROM (SELECT cp_density, split_part(experiment, '-', 2) || '-' || split_part(experiment, '-', 3) || '-' || split_part(experiment, '-', 4) || '-' || split_part(experiment, '-', 5) AS x, avg(id)::DOUBLE AS id, unnest(['electricity', 'heat', 'gas']) AS carrier, unnest([sum(c0) / (count(*) * 100.0::DOUBLE), sum(c1) / (count(*) * 100.0::DOUBLE), sum(c2) / (count(*) * 100.0::DOUBLE)]) AS resilience_mean FROM (SELECT cp_density, experiment, id, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2 FROM perf GROUP BY ALL) GROUP BY cp_density, experiment)", "perf"),
    "run_total": _sql("SELECT * FROM total", "total"),
    "impact_children": _sql("SELECT * FROM children", "children"),
    "impact_extended": _sql("SELECT cp_density, node, type, carrier, impact::DOUBLE AS impact, 'own' AS origin FROM milli UNION ALL SELECT cp_density, node, type, carrier, impact, 'children' FROM children", "children"),
    "rollup_grouping_sets": _sql(" UNION ALL ".join(f"SELECT '{n}' AS rollup, {', '.join(k if k in keys else 'NULL AS ' + k for k in ('type_carrier', 'type', 'carrier', 'cp_density'))}, sum(abs(impact)) / count(*)::DOUBLE AS mean, sum(abs(impact))::BIGINT AS total FROM milli WHERE impact IS NOT NULL GROUP BY {', '.join(keys)}" for n, keys in {"type_carrier": ("type_carrier", "carrier"), "type": ("type", "carrier"), "type_carrier_density": ("type_carrier", "carrier", "cp_density"), "carrier_density": ("carrier", "cp_density")}.items()), "milli"),
    "metric_impact_join": _sql("SELECT * FROM joined", "joined"),
    "metric_impact_all": _sql("SELECT type_y, cp_density, node, betweenness_centrality, degree, vc, katz, sum(impact)::BIGINT AS impact FROM joined GROUP BY ALL", "joined"),
    "type_groups": _sql("SELECT type_group, carrier, count(*) AS n, sum(impact)::BIGINT AS impact FROM joined JOIN groups USING (type_y) GROUP BY ALL", "joined", "groups"),
    "metric_impact_frame": _sql("SELECT carrier, cp_density, node, type_y, type_group, impact, unnest(['betweenness_centrality', 'degree', 'vc', 'katz']) AS metric, unnest([betweenness_centrality, degree, vc, katz]) AS value FROM framed", "framed"),
    "locf_performance": _sql("SELECT id, step, last_value(c0 IGNORE NULLS) OVER (PARTITION BY id ORDER BY step) AS c0 FROM (SELECT id, step, c0 FROM (SELECT DISTINCT id FROM perf) CROSS JOIN range(30) r(step) LEFT JOIN (SELECT id, step, sum(c0)::BIGINT AS c0 FROM perf WHERE step % 3 = 0 GROUP BY ALL) USING (id, step))", "perf"),
    "padded_series": _sql("SELECT id, step::INT AS step, coalesce(c0, 0) AS c0 FROM (SELECT DISTINCT id FROM perf) CROSS JOIN range(30) r(step) LEFT JOIN (SELECT id, step, c0 FROM perf) USING (id, step)", "perf"),
    "fault_state": _sql("SELECT id, node, step::INT AS step, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY id, node ORDER BY step), 1) = 1 AS active FROM (SELECT DISTINCT id, node FROM moves) CROSS JOIN range(30) r(step) LEFT JOIN (SELECT id, node, step, max_by(kind, position) AS kind FROM moves WHERE step < 30 GROUP BY ALL) USING (id, node, step)", "moves"),
    "state_intervals": _sql("SELECT id, node, min(step) AS begin, (max(step) + 1)::INT AS until, active FROM (SELECT *, step - row_number() OVER (PARTITION BY id, node, active ORDER BY step) AS z FROM states) GROUP BY id, node, active, z", "states"),
    "states_at_changes": _sql("SELECT states.* FROM states JOIN (SELECT id, step FROM moves UNION SELECT id, 0 FROM moves) USING (id, step)", "states", "moves"),
    "change_steps": _sql("SELECT id, step FROM moves UNION SELECT id, 0 FROM moves", "moves"),
    "upsample": _sql("SELECT profile, hour, kw, unnest(range(4 * hour, 4 * hour + 4)) AS step FROM hourly", "hourly"),
    "prefix_rows": _sql("SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY profile ORDER BY hour) <= 8", "hourly"),
    "profile_demand": _sql("SELECT hour, sum(CASE profile WHEN 'P' THEN -kw ELSE kw END)::BIGINT AS kw FROM hourly GROUP BY ALL", "hourly"),
    "profile_scale": _sql("SELECT profile, hour, kw * 1000 AS heat, kw / 54000.0::DOUBLE AS gas FROM hourly", "hourly"),
    "positional_profile": _sql("SELECT c.component_id, h.profile, h.hour, h.kw * (c.component_id + 1) AS value FROM hourly h JOIN (SELECT profile, row_number() OVER (ORDER BY profile) AS i FROM (SELECT DISTINCT profile FROM hourly)) USING (profile) JOIN (SELECT component_id, row_number() OVER (ORDER BY component_id) AS i FROM (SELECT component_id FROM parts WHERE type = 'PowerGenerator' ORDER BY 1 LIMIT 3)) c USING (i)", "hourly", "parts"),
    "random_profile": _sql(f"SELECT component_id, step::INT AS step, round(abs({_normal(0.0, 0.1, '101', 'component_id', 'step')}), 9) AS value FROM parts, range(4) r(step) WHERE type = 'Source'", "parts"),
    "random_demand": _sql(f"SELECT CASE grid WHEN 'power' THEN 'electricity' WHEN 'water' THEN 'heat' ELSE 'gas' END AS carrier, component_id, step::INT AS step, round(CASE grid WHEN 'water' THEN v ELSE abs(v) END, 9) AS value FROM (SELECT grid, component_id, step, {_normal(0.0, 0.1, '101', 'component_id', 'step')} AS v FROM parts, range(4) r(step) WHERE grid IS NOT NULL)", "parts"),
    "profile_sum": _sql("SELECT profile, hour, (kw * CASE WHEN kw % 2 = 0 THEN 3 ELSE 1 END)::BIGINT AS kw FROM hourly", "hourly"),
    "hazard_prob": _sql("SELECT run_id, component_id, time, round(p, 9) AS probability FROM trial", "trial"),
    "failures": _sql("SELECT run_id, component_id, time, round(p, 9) AS severity, 0 AS effect FROM fail", "fail"),
    "repairs": _sql("SELECT run_id, component_id, time, round(damage, 9) AS damage, repaired_time FROM rep", "rep"),
    "event_log": _sql("SELECT run_id, component_id, node, step, type FROM log WHERE step < 32", "log"),
    "simulated_performance": _sql("SELECT r.run_id, t.step::INT AS step, round(coalesce(sum(CASE grid WHEN 'power' THEN nominal END), 0), 4) AS p0, round(coalesce(sum(CASE grid WHEN 'water' THEN nominal END), 0), 4) AS p1, round(coalesce(sum(CASE grid WHEN 'gas' THEN nominal END), 0), 4) AS p2 FROM range(3) r(run_id) CROSS JOIN range(32) t(step) LEFT JOIN (SELECT run_id, x, y, grid, nominal FROM (SELECT run_id, component_id, step AS x, what, lead(step, 1, 32) OVER (PARTITION BY run_id, component_id ORDER BY step) AS y FROM (SELECT run_id, component_id, step, max(type) AS what FROM log WHERE step < 32 GROUP BY ALL)) JOIN parts USING (component_id) WHERE what = 'failure') f ON f.run_id = r.run_id AND t.step >= x AND t.step < y GROUP BY ALL", "log", "parts"),
    "violation_prob": "SELECT event_id, round(v, 9) AS violation, round(pow(v * 100, 1.5) / 100, 6) AS probability FROM (SELECT event_id, greatest((abs(value / 100 - 1) - 0.1 * 1.0) / (1.0 * 0.1), 0) AS v FROM events)",
    "load_components": _sql(f"SELECT component_id, type, is_load, dependent, CASE WHEN dependent THEN 'cp' WHEN contains(type, 'Water') THEN 'heat' WHEN contains(type, 'Gas') THEN 'gas' WHEN contains(type, 'Power') OR type = 'Bus' THEN 'power' ELSE 'heat' END AS plot_class FROM (SELECT component_id, {_list(fx.TYPES)}[component_id % 20 + 1] AS type, coalesce(type = 'PowerLoad' OR (type = 'Sink' AND grid = 'gas') OR type = 'HeatExchangerLoad', false) AS is_load, NOT independent AS dependent FROM (SELECT * EXCLUDE (type) FROM parts)) WHERE is_load OR dependent", "parts"),
    "eligible_components": _sql("SELECT kind, type, count(*) AS n FROM own GROUP BY ALL", "own"),
    "balance": "SELECT s_nationkey::BIGINT AS run_id, sum(CASE WHEN s_suppkey % 2 = 0 THEN CAST(round(s_acctbal * 100) AS BIGINT) END)::BIGINT AS p_mw, sum(CASE WHEN s_suppkey % 2 = 1 THEN CAST(round(s_acctbal * 100) AS BIGINT) END)::BIGINT AS mass_flow FROM supplier GROUP BY ALL",
    "node_deactivation": _sql("SELECT node, count(*) AS n FROM (SELECT node FROM keyed WHERE type = 'failure' UNION ALL SELECT child FROM keyed JOIN members USING (node) WHERE keyed.type = 'failure' AND members.cp_density = 0) GROUP BY ALL", "keyed", "members"),
    "experiment_sweep": "SELECT n AS run_number, ((n - 1) % 3)::INT AS impact_no, (((n - 1) // 3) % 5)::INT AS density_no, (n * 2000 + 7)::BIGINT AS run_id, concat_ws('-', 'x', impact_no, density_no, impact_no, density_no, (density_no / 2.0::DOUBLE)::VARCHAR) AS folder FROM range(1, 301) t(n)",
    "failure_text": _sql("SELECT component_id, (component_id % 3) || '-' || (component_id % 7) || '.1.0: ' || concat_ws('.', coalesce(grid, 'none'), type, component_id) AS failure, 'Fault(executor=component, start_time=' || (component_id % 3) || ', stop_time=' || (component_id % 7) || ')' AS fault, 'ba' || component_id AS slug FROM parts", "parts"),
    "component_values": _sql("SELECT component_id, component_id AS number, type AS class, concat_ws(':', component_id % 3, kind, component_id) AS legacy, CASE WHEN component_id % 2 = 0 THEN 'even' ELSE 'untitled' END AS title, round(nominal * (1 - component_id % 10 / 100.0::DOUBLE), 6) AS low, round(nominal * (1 + component_id % 10 / 100.0::DOUBLE), 6) AS high, round(component_id / 10.0::DOUBLE * 3600 / 1e3, 6) AS mw, component_id * CASE WHEN grid = 'water' THEN 3 ELSE 2 END AS loss, CAST(trunc(" + _u("'p'", "component_id") + " * " + _u("'u'", "component_id") + " * 10) AS INT) AS duration FROM parts", "parts"),
    "degree": _sql("SELECT 0::BIGINT AS network_id, * FROM deg", "deg"),
    "edge_degree": _sql("SELECT 0::BIGINT AS network_id, u, v, 0::BIGINT AS key, a.degree + b.degree AS degree FROM edges JOIN deg a ON a.id = u JOIN deg b ON b.id = v", "deg"),
    "apsp": _sql("SELECT s, t, d FROM dist WHERE s <> t", "dist"),
    "betweenness": _sql("SELECT id, round(bc, 9) AS bc FROM bc", "bc"),
    "edge_betweenness": _sql("SELECT u, v, round(bc, 9) AS bc FROM ebc", "ebc"),
    "vitality": _sql("SELECT id, vc FROM vit", "vit"),
    "katz": _sql("SELECT id, round(katz, 9) AS katz FROM kz", "kz"),
    "group_betweenness": _sql("SELECT group_id::BIGINT AS group_id, round(bc, 9) AS bc FROM gbc", "gbc"),
    "metrics_table": _sql("SELECT 'node:' || id AS id, 'Bus' AS type, degree, round(bc, 9) AS betweenness_centrality, round(vc, 9) AS vc, round(katz, 9) AS katz FROM own_all UNION ALL SELECT 'child:' || id, 'PowerLoad', degree, round(bc, 9), round(vc, 9), round(katz, 9) FROM own_all WHERE id < 10 UNION ALL SELECT 'branch:(' || u || ', ' || v || ', 0)', 'GenericPowerBranch', a.degree + b.degree, round(ebc.bc, 9), round((a.vc + b.vc) / 2, 9), round((a.katz + b.katz) / 2, 9) FROM ebc JOIN own_all a ON a.id = u JOIN own_all b ON b.id = v UNION ALL SELECT 'compound:' || grp.id, grp.type, sum(degree)::BIGINT, round(any_value(gbc.bc), 9), round(avg(vc), 9), round(avg(katz), 9) FROM grp JOIN gbc ON gbc.group_id = grp.id JOIN own_all ON list_contains(m, own_all.id) GROUP BY grp.id, grp.type", "deg", "bc", "vit", "kz", "ebc", "gbc"),
    "grid_edges": _sql("SELECT net AS network_id, u, v, key, w::BIGINT AS w FROM medges", "medges"),
    "grid_measures": _sql("SELECT net AS network_id, id, round(bc, 9) AS bc, vc FROM mbc JOIN mvit USING (net, id)", "mbc", "mvit"),
    "grid_katz": _sql("SELECT net AS network_id, id, round(katz, 9) AS katz FROM mkz", "mkz"),
    "grid_group_betweenness": _sql("SELECT net AS network_id, group_id, round(bc, 9) AS bc FROM mgbc", "mgbc"),
    "grid_metrics": _sql("SELECT net * 0.5::DOUBLE AS cp_density, i AS id, type, degree, round(bc, 9) AS betweenness_centrality, round(vc, 9) AS vc, round(katz, 9) AS katz FROM (SELECT net, 'node:' || id AS i, 'Bus' AS type, degree, bc, vc, katz FROM mall UNION ALL SELECT mall.net, 'child:' || c_custkey, 'PowerLoad', degree, bc, vc, katz FROM customer JOIN mgrp ON mgrp.id = c_nationkey JOIN mall ON mall.id = mgrp.first UNION ALL SELECT mebc.net, 'branch:(' || u || ', ' || v || ', ' || key || ')', 'GenericPowerBranch', a.degree + b.degree, mebc.bc, (a.vc + b.vc) / 2, (a.katz + b.katz) / 2 FROM mebc JOIN mall a ON a.id = u JOIN mall b ON b.id = v UNION ALL SELECT g.net, 'compound:' || g.id, CASE WHEN g.id % 2 = 0 THEN 'CHP' ELSE 'PowerToHeat' END, sum(degree)::BIGINT, any_value(mgbc.bc), avg(vc), avg(katz) FROM (SELECT id, net, unnest([first, last]) AS node FROM mgrp) g JOIN mall ON mall.id = g.node JOIN mgbc ON mgbc.group_id = g.id GROUP BY g.id, g.net)", "mall", "mebc", "mgbc", "mgrp"),
    "network_frame": _sql("SELECT u, v, (u % 5)::DOUBLE AS x0, floor(u / 5)::DOUBLE AS y0, (v % 5)::DOUBLE AS x1, floor(v / 5)::DOUBLE AS y1, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS color FROM (SELECT u, v, CASE WHEN w % 2 = 0 THEN w ELSE 0 END::DOUBLE AS value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM edges)", "edges"),
    "network_points": _sql("SELECT id, (id % 5)::DOUBLE + [0.0, 0.0003, 0.0006, 0.0003][g]::DOUBLE AS x, floor(id / 5)::DOUBLE + [0.0, 0.0003, 0.0006, -0.0003][g]::DOUBLE AS y, class, color, concat_ws(' - ', ['PowerGrid', 'WaterGrid', 'GasGrid', 'NoGrid'][g], CASE g WHEN 1 THEN 'Bus' ELSE 'Junction' END, color::VARCHAR) AS text FROM (SELECT id, id % 4 + 1 AS g, CASE WHEN id % 6 = 3 THEN 'cp' ELSE ['power', 'heat', 'gas'][id % 4 + 1] END AS class, CASE WHEN id % 2 = 0 THEN id / 4.0::DOUBLE ELSE 0 END AS color FROM nodes) WHERE class IS NOT NULL", "nodes"),
    "density_network": _sql("SELECT node AS id, cp_density, network_id FROM metrics LEFT JOIN (SELECT ((s_suppkey % 4) * 0.5)::DOUBLE AS cp_density, arg_min(s_suppkey, s_name)::BIGINT AS network_id FROM supplier GROUP BY 1) USING (cp_density)", "metrics"),
    "densities": _sql("SELECT DISTINCT cp_density FROM perf", "perf"),
    "ybus": _sql("SELECT i, j, round(sum(re), 6) AS re, round(sum(im), 6) AS im FROM (SELECT f AS i, t AS j, -g / a AS re, -b / a AS im FROM pi UNION ALL SELECT t, f, -g / a, -b / a FROM pi UNION ALL SELECT f, f, g / (a * a), b / (a * a) + 0.01 FROM pi UNION ALL SELECT t, t, g, b + 0.01 FROM pi) GROUP BY ALL", "pi"),
    "line_flow": _sql("SELECT branch, round(vi * vi / (a * a) * g - vi * vj / a * (g * cos(dth) + b * sin(dth)), 6) AS p_from FROM pi", "pi"),
    "grid_injections": _sql("SELECT net AS network_id, i AS id, CASE WHEN round(p, 6) = 0 THEN 0 ELSE round(p, 6) END AS p, CASE WHEN round(q, 6) = 0 THEN 0 ELSE round(q, 6) END AS q FROM gpq", "gpq"),
    "grid_jacobian": _sql("SELECT net AS network_id, r, c, CASE WHEN round(value, 6) = 0 THEN 0 ELSE round(value, 6) END AS value FROM gjac", "gjac"),
    "ptdf": _sql("SELECT net::BIGINT AS network_id, s::BIGINT AS s, t::BIGINT AS t, branch, CASE WHEN round(ptdf, 9) = 0 THEN 0 ELSE round(ptdf, 9) END AS ptdf FROM nflow", "nflow"),
    "grid_ptdf": _sql("SELECT net AS network_id, s, t, branch, CASE WHEN round(ptdf, 6) = 0 THEN 0 ELSE round(ptdf, 6) END AS ptdf FROM gflow", "gflow"),
    "grid_singular_values": _sql("SELECT net AS network_id, round(sqrt(l.top), 6) AS largest, round(1 / sqrt(s.top), 6) AS smallest FROM gltop l JOIN gstop s USING (net)", "gltop", "gstop"),
    "transfer_residual": _sql("SELECT net AS network_id, s, t, 0.0::DOUBLE AS residual FROM gtr", "gtr"),
    "variance_indicator": _sql("SELECT cp_density, round(var_pop(total) / 10 / 1e6, 4) AS indicator FROM (SELECT * FROM total QUALIFY row_number() OVER (PARTITION BY cp_density ORDER BY id) <= 100) GROUP BY ALL", "total"),
    "iteration_stop": _sql("SELECT cp_density, count(*) - 1 > 20 AS stop FROM total GROUP BY ALL", "total"),
    "kalman_smooth": _sql("SELECT cp_density, t, round(mean, 6) AS mean, round(var, 6) AS var, round(change, 6) AS change FROM ksmo", "ksmo"),
    "mgbm": _sql("SELECT cp_density, n AS runs, n >= 2 AND m0 + p0 / (p0 + r) * (y - m0) < 0.1 AS stop FROM em10 JOIN gser USING (cp_density) WHERE t = n - 1", "em10"),
    "grouped_hist": _sql("SELECT type, carrier, sum(impact)::BIGINT AS impact FROM milli WHERE impact IS NOT NULL GROUP BY ALL", "milli"),
    "multilevel_bar": _sql("SELECT i + 0.5::DOUBLE * (i // 3) AS x, cp_density, experiment, carrier, value, sum(value) OVER (PARTITION BY i)::BIGINT AS height, max(h) OVER () + 0.5::DOUBLE AS y_end FROM (SELECT *, row_number() OVER (ORDER BY cp_density, experiment) - 1 AS i, c0 + c1 + c2 AS h FROM (SELECT cp_density, experiment, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1, sum(c2)::BIGINT AS c2 FROM perf GROUP BY ALL)) CROSS JOIN LATERAL (SELECT unnest(['c0', 'c1', 'c2']) AS carrier, unnest([c0, c1, c2]) AS value)", "perf"),
    "multi_bar": _sql("SELECT cp_density, unnest(['electricity', 'heat', 'gas']) AS name, unnest([sum(c0), sum(c1), sum(c2)])::DOUBLE AS y FROM perf GROUP BY cp_density", "perf"),
    "wide_profiles": _sql("SELECT hour, " + ", ".join(f"(sum(kw) FILTER (profile = '{p}'))::BIGINT AS \"{p}\"" for p in "FOP") + " FROM hourly GROUP BY hour", "hourly"),
    "external_grids": "SELECT s_nationkey::BIGINT AS network_id, max(v) FILTER (s_suppkey % 2 = 0 AND k = 1) AS power, max(v) FILTER (s_suppkey % 2 = 1 AND k = 2) AS gas FROM (SELECT *, CAST(round(s_acctbal * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) AS k FROM supplier) GROUP BY 1",
    "relevant_components": _sql(f"SELECT id, type, kind FROM (SELECT component_id AS id, kind, grid, {_list(fx.TYPES)}[component_id % 20 + 1] AS type FROM (SELECT * EXCLUDE (type) FROM parts)) WHERE kind IN ('child', 'branch') AND (type = 'PowerLoad' OR (type = 'Sink' AND grid = 'gas') OR type = 'HeatExchangerLoad')", "parts"),
    "numbered_orders": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY cents, o_orderkey) - 1 AS place FROM orders",
    "color_range": _sql("SELECT net AS network_id, min(c)::DOUBLE AS least, max(c)::DOUBLE AS greatest FROM (SELECT net, degree AS c FROM mdeg UNION ALL SELECT net, w FROM medges) GROUP BY net", "mdeg", "medges"),
    "line_frame": _sql("SELECT step, unnest(['c0', 'c1', 'c2']) AS line, unnest([sum(c0), sum(c1), sum(c2)])::DOUBLE AS value FROM perf GROUP BY step", "perf"),
}
for _name, _keys in {"type_carrier": "type_carrier, carrier", "type": "type, carrier", "type_carrier_density": "type_carrier, carrier, cp_density", "carrier_density": "carrier, cp_density"}.items():
    for _how, _agg in (("mean", "sum(abs(impact)) / count(*)::DOUBLE"), ("sum", "sum(abs(impact))::BIGINT")):
        ORACLES[f"rollup_{_name}_{_how}"] = _sql(f"SELECT {_keys}, {_agg} AS impact FROM milli WHERE impact IS NOT NULL GROUP BY ALL", "milli")
ORACLES["folder_rollups"] = ORACLES["rollup_grouping_sets"]
ORACLES["metrics_table"] = ORACLES["metrics_table"].replace(" SELECT 'node:' || id AS id", ", own_all AS MATERIALIZED (SELECT * FROM deg JOIN bc USING (id) JOIN vit USING (id) JOIN kz USING (id)) SELECT 'node:' || id AS id", 1)
