"""Runs, nearest vectors and rearranged texts against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridspark.llm import fim, neighbours, repeats
from gridspark.llm.queries import QUERIES

rng = random.Random(17)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- periodic runs


def plain_runs(words, least=6, times=4):
    """Every stretch of equal words q apart, for each q; of equal stretches the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_rewritten(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k if k < a else a + (k - a) % p] for k in range(n)]


def plain_collapsed(words, runs):
    lost = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in lost)


def repetitive(n):
    out = []
    while len(out) < n:
        cycle = [rng.choice(("a", "b", "é", "A")) for _ in range(rng.randint(1, 7))]
        out += (cycle * rng.randint(1, 8))[: rng.randint(1, 40)]
    return rng.choice((" ", "\n", " \t")).join(out[:n])


RUNS = [None, "", " \x0b\n", "one", "x x x x x", "x x x x x x", "a a a a a a", "ab ab ab ab " * 3000, "a a a a a a b a a a a a a b " * 4]
RUNS += [repetitive(rng.randint(1, 300)) for _ in range(60)] + [" ".join(str(rng.random()) for _ in range(4000)) + " z z z z z z z"]


def test_overlap():
    assert repeats.overlap(6, 4) == 5 and repeats.overlap(2, 2) == 1


@pytest.mark.parametrize("rows", [[], list(enumerate(RUNS)), [(None, RUNS[5]), (7, RUNS[6]), (7, RUNS[6]), (7, RUNS[8])]])
def test_runs_and_collapse(docs, rows):
    got = sorted(((r.doc_id, r.n_words, r.collapsed.encode(), [tuple(x) for x in r.runs], r.best and tuple(r.best)) for r in repeats.find(docs(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        w = WORD.findall((t or "").encode())
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((i, len(w), plain_collapsed(w, runs), runs, best))
    assert got == sorted(want, key=repr)


def test_words_that_overlap_by_thue_and_morse(docs):
    """No stretch of this text comes three times in a row, however alike its halves are."""
    t = "".join(str(bin(k).count("1") % 2) for k in range(1 << 13))
    assert repeats.find(docs([(1, " ".join(t))])).first().runs == []


def test_masked_words_are_in_no_run():
    for _ in range(50):
        ids = np.array([rng.randrange(3) for _ in range(rng.randint(0, 80))], np.int64)
        kept = repeats.survivors(ids, np.zeros(len(ids), np.int64), repeats.overlap(6, 4))
        assert all(kept[s : s + n].all() for s, n, _ in plain_runs(ids.tolist()))


def test_runs_query(spark, docs, tmp_path):
    rows = list(enumerate(RUNS * 3))
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = plain_rewritten(i, WORD.findall((t or "").encode()))
        runs, r = plain_runs(w), got[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs)).hexdigest()


# --- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = [None, "", " ", "a", " a", "a ", "über  öl\n\nß€😀 x", "<P", "a<P>b", "a <<M>> b", "<S > <S>", "< P> <p> <PP> <P > <<P", "   x\u0085y"]


def plain_form(i, text):
    t = UNIT.findall(text)
    h = hashlib.sha256(f"42:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(t), "plain", None, None, text
    if h4 % 100 < 80:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def spelled(n):
    return "".join(rng.choice((" ", "\n", "\x0b", "a", "é", "€", "😀", "<", ">", "P", "S", "M", " ", "<P")) for _ in range(n))


@pytest.mark.parametrize("rows", [[], [(i, t) for i, t in enumerate(MARKED * 8)], [(i, spelled(rng.randint(0, 900))) for i in range(300)], [(5, "x" * 70000 + " é " * 70000), (5, "a b"), (5, "a b"), (5, "c")]])
def test_rearranged(docs, rows):
    out = fim.rearrange(docs(rows))
    got = [tuple(r) for r in out.withColumn("again", fim.restored(out.output, out.form)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_form(i, t or ""), t or "") for i, t in rows), key=repr)
    if len(rows) == 300:
        assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_null_id_is_rearranged_too(docs):
    assert fim.rearrange(docs([(None, "a b c")])).first().n == 3


# --- nearest vectors


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, score string")


def plain_nearest(rows, every, k):
    """All inner products; ids repeat with their best one."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            for j, v in good:
                if j != i:
                    out.setdefault(i, {})[j] = max(out.get(i, {}).get(j, -np.inf), float((q * v).sum()))
    return {i: sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k] for i, s in out.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_few_vectors_are_all_found(spark, kind):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(5).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, [1.0] * 5), (61, [1.0] * 5), (62, [1.0] * 5), (0, [1.0] * 5), (63, None), (64, [0.0] * 5), (65, [1.0, None, 0.0, 0.0, 0.0]), (66, [float("nan")] * 5), (67, [float("inf")] * 5), (None, [1.0] * 5), (68, [2.0] * 4), (69, [])]
    got = {}
    for x in neighbours.nearest(vectors(spark, rows, kind)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = plain_nearest([(i, v) for i, v in rows if i not in (68, 69)], 20, 20)
    assert {i: [v for v, _ in x] for i, x in got.items()} == {i: [v for v, _ in x] for i, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for i in got for a, b in zip(got[i], want[i], strict=True))


def test_no_vectors(spark):
    assert neighbours.nearest(vectors(spark, [])).collect() == [] and neighbours.nearest(vectors(spark, [(0, None), (20, [0.0])])).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1.0])])).collect() == []


@pytest.mark.parametrize("shape", ["even", "groups", "lengths", "copies"])
def test_recall_and_places(spark, monkeypatch, shape):
    """Recall, whole ranks and exact scores, also where a leaf is dealt over several places and trees know a sample only."""
    monkeypatch.setattr(neighbours, "PLACE", 200)
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 16))
    if shape == "groups":
        x = 0.3 * x + r.standard_normal((20, 16))[r.integers(0, 20, len(x))]
    if shape == "lengths":
        x *= np.exp(r.standard_normal(len(x)))[:, None]
    if shape == "copies":
        x[::3] = x[0]
    x = x.astype(np.float32).astype(float)
    found = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), leaf=64, sample=1000).collect()
    got = {}
    for f in sorted(found, key=lambda f: (f.query_id, f.rank)):
        got.setdefault(f.query_id, []).append((f.vec_id, f.score))
        assert f.score == pytest.approx(float(x[f.query_id] @ x[f.vec_id]), rel=1e-12, abs=1e-12)
    want = plain_nearest(list(enumerate(x.tolist())), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 and v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    assert np.mean([len({v for v, _ in got[i]} & {v for v, _ in want[i]}) / 20 for i in got]) >= 0.9


def test_search_takes_branches_in_order():
    """The queue gives leaves by their distance beyond the boundaries, over all trees."""
    r = np.random.default_rng(4)
    x = r.standard_normal((500, 6))
    forest = neighbours.grow(x, float(neighbours.norms(x)[0].max()), 3, 16, 1)
    order = next(forest.search(x[:1], np.ones(3 << forest.depth, int), np.inf))
    margin = forest.margins(np.hstack([neighbours.norms(x[:1])[1], [[0.0]]]))[0]

    def far(leaf):
        tree, node, total = leaf >> forest.depth, (leaf & ((1 << forest.depth) - 1)) + (1 << forest.depth) - 1, 0.0
        while node:
            up = (node - 1) // 2
            m = margin[tree, up]
            total += m * m * ((m >= 0) != (node == 2 * up + 2))
            node = up
        return total

    assert sorted(order) == list(range(3 << forest.depth))
    assert np.all(np.diff([far(f) for f in order]) >= -1e-12)
