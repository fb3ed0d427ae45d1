"""Operators with one right answer, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridspark.llm import bpe, decontamination, jaccard, ppm, search, sharding

random.seed(3)
VOCABULARY = ["".join(random.choice("abcdefg") for _ in range(random.randint(1, 4))) for _ in range(60)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def texts():
    base = prose(120)
    near = base.split()
    out = [None, "", "  \n", "one", "One  two\tthree", prose(5), prose(40), prose(3000), base, base, base.upper()]
    for k in range(12):
        w = list(near)
        for _ in range(k // 2):
            w[random.randrange(len(w))] = "edit" + str(random.random())
        out.append(" ".join(w))
    return out + [prose(30) + " " + base[:200] + " " + prose(30) for _ in range(6)]


TEXTS = list(enumerate(texts()))


def words(t):
    return (t or "").encode().lower().split()


# --- sharding


def test_karmarkar_karp():
    w = [random.randint(1, 10**6) for _ in range(400)]
    loads = [0] * 8
    for x, s in zip(w, sharding.karmarkar_karp(w, 8), strict=True):
        loads[s] += x
    assert max(loads) - min(loads) < 2000
    assert sharding.karmarkar_karp([], 3) == [] and sorted(sharding.karmarkar_karp([8, 7, 6, 5, 4], 2)) == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("rows", [[], TEXTS, TEXTS + TEXTS[:4], [(k, "same" if k % 3 else prose(5)) for k in range(90)]])
def test_shards(docs, rows):
    got = sharding.shard(docs(rows), lanes=7).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of = defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        slots[r.shard].append(r.slot)
        of[text[r.doc_id] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


def plain_differencing(weights, shards):
    """Loads after combining the two vectors of largest spread, heavy with light, until one is left."""
    parts = [sorted([w] + [0] * (shards - 1), reverse=True) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda v: v[-1] - v[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


@pytest.mark.parametrize("n, shards", [(5, 2), (12, 3), (40, 4), (7, 8)])
def test_differencing_against_a_plain_one(n, shards):
    w = random.sample(range(1, 10**7), n)  # distinct ones, so that spreads do not tie
    loads = [0] * shards
    for x, s in zip(w, sharding.karmarkar_karp(w, shards), strict=True):
        loads[s] += x
    assert sorted(loads, reverse=True) == plain_differencing(w, shards)


# --- byte-level BPE


PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).ranks, special_tokens={})


ODD = ["", " ", "  ", "don't we've 's x 're '\n's", "it'l 'll\t\tx 　y ½²3", "x'", "é'dx'", "a" * 3000, "ab" * 2000, "<|endoftext|>", " \n\n  x", "'", "''s", "x y   z", "日本語 テスト🙂", "".join(random.choice("abcdé中 '\n1!") for _ in range(20000)), "".join(random.choice("abcdefgh") for _ in range(3000))]


def test_bpe_is_tiktoken(reference):
    c = bpe.codec(PATH, PATTERN)
    for t in ODD + [t or "" for _, t in TEXTS]:
        assert c.encode(t) == reference.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t


def test_bpe_classes_are_tiktokens(reference):
    c, some = bpe.codec(PATH, PATTERN), ["中", " ", "a", "1", "\U000328B6", "\U0003E788", "\x1c", "\x85", "\u180e", "\u0345"]
    for _ in range(3000):
        t = "".join(random.choice([*some, chr(random.randrange(0x20000, 0x110000))]) for _ in range(8))
        assert c.encode(t) == reference.encode_ordinary(t)


def test_bpe_other_pattern(reference):
    c = bpe.Codec(bpe.codec(PATH, PATTERN).ranks, r"\w+|\W")
    e = tiktoken.Encoding("o", pat_str=r"\w+|\W", mergeable_ranks=c.ranks, special_tokens={})
    assert all(c.encode(t) == e.encode_ordinary(t) for t in ODD)


def test_rank_queue():
    q, ranks = bpe.RankQueue(), [random.randrange(1 << 18) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (x := q.pop_rank()) is not None:
        out += [(x[0], i) for i in x[1]]
    assert out == sorted((r, i) for i, r in enumerate(ranks))


def test_bpe_digests(docs, reference):
    rows = [(i, t) for i, t in enumerate([None, *ODD])]
    got = {r.doc_id: r for r in bpe.digests(docs(rows), PATH, PATTERN).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = bpe.encode(docs(rows), PATH, PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded, PATH, PATTERN).collect()} == {i: t or "" for i, t in rows}
    assert bpe.digests(docs([]), PATH, PATTERN).count() == 0


# --- language model


@pytest.mark.parametrize("settings", [{}, {"heavy_share": 64, "most_grams": 500}, {"order": 2}])
def test_scores(docs, settings):
    got = {r.doc_id: r for r in ppm.score(docs(TEXTS), **settings).collect()}
    count = Counter()
    for i, t in TEXTS:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t) + [b""])
    n, v = sum(count.values()), len(count)
    for i, t in TEXTS:
        w, r = words(t) + [b""], got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))


def plain_ppm(grams, order, context, symbol):
    """Probability by walking the contexts, excluding what longer ones have seen."""
    p, excluded = 1.0, set()
    for k in range(order, -1, -1):
        seen = Counter()
        for g, c in grams.items():
            if g[order - k : order] == context[order - k :]:
                seen[g[order]] += c
        if not seen:
            continue
        left = {s: 2 * c - 1 for s, c in seen.items() if s not in excluded}
        if not left:
            excluded |= set(seen)
            continue
        total = sum(left.values()) + len(left)
        if symbol in left:
            return p * left[symbol] / total
        p *= len(left) / total
        excluded |= set(seen)
    return p / (256 - len(excluded))


def test_ppm_against_a_walk():
    order, text = 3, b"abracadabra abrakadabra"
    stream = b"\xff" * order + text + b"\xff"
    grams = Counter(stream[i : i + order + 1] for i in range(len(text) + 1))
    code = lambda g: int.from_bytes(g, "big")
    model = ppm.Ppm(np.array([code(g) for g in grams], np.uint64), np.array(list(grams.values())), order)
    for context in (b"abr", b"\xff\xff\xff", b"xyz", b"xbr", b"xxa", b"ra "):
        got = np.exp(model.logs(np.array([code(context + bytes([s])) for s in range(256)], np.uint64)))
        assert got.sum() == pytest.approx(1, abs=1e-5)
        for s in b"ack zr\xff":
            assert got[s] == pytest.approx(plain_ppm(grams, order, context, s), rel=1e-4)


def test_score_against_a_walk(docs):
    order, rows = 3, [(i, t) for i, t in enumerate(["abracadabra", "Abra kadabra", None, "", "é abra", "zzz", "cadabra " * 3, "brac"])]
    grams = Counter()
    stream = lambda t: b"\xff" * order + (t or "").encode().lower() + b"\xff"
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            grams.update(stream(t)[k : k + order + 1] for k in range(len(stream(t)) - order))
    for settings in ({}, {"most_grams": 10}, {"most_grams": 3}):  # 3: endings of two bytes are cut, "abr" among them
        for r in ppm.score(docs(rows), order=order, **settings).collect():
            t = stream(rows[r.doc_id][1])
            want = sum(math.log10(plain_ppm(grams, order, t[k : k + order], t[k + order])) for k in range(len(t) - order))
            assert r.score == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("most", [1, 4, 10, 1000])
def test_blocks_answer_every_code_once(spark, most):
    order, text = 4, b"xaab yaab zaab waab xaac yabc xaad xaae xaaf " * 2
    stream = b"\xff" * order + text + b"\xff"
    grams = Counter(int.from_bytes(stream[i : i + order + 1], "big") for i in range(len(text) + 1))
    whole = ppm.Ppm(np.array(list(grams), np.uint64), np.array(list(grams.values())), order)
    r = np.random.default_rng(5)
    code = np.array(list(grams) + [int.from_bytes(bytes(r.choice(list(b"xyzwabcdef q"), order + 1).tolist()), "big") for _ in range(3000)], np.uint64)
    got, times = np.zeros(len(code)), np.zeros(len(code), int)
    blocks = list(ppm._blocks(spark.createDataFrame(list(grams.items()), "key long, n long"), order, most))
    for model, covers in blocks:
        mine = np.ones(len(code), bool) if covers is None else covers(code)
        got[mine] += model.logs(code[mine])
        times += mine
        assert len(model.gram_keys[order]) <= max(most, 256)
    assert (times == 1).all() and got == pytest.approx(whole.logs(code), rel=1e-5)
    assert (len(blocks) == 1) == (most == 1000) and (most > 4 or any(c.depth > 2 for _, c in blocks))


def test_ppm_of_nothing(docs):
    assert ppm.score(docs([])).count() == 0
    held = [(i, "ab") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {round(r.score, 6) for r in ppm.score(docs(held)).collect()} == {round(3 * math.log10(1 / 256), 6)}


# --- similar texts


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("stars", [0, 2])
def test_jaccard(docs, stars):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(TEXTS), stars=stars).collect()}
    assert got == plain_components(TEXTS)


def test_connected():
    path = np.zeros((4, 4), bool)
    path[[0, 1, 1, 3], [1, 0, 3, 1]] = True  # 0-1-3 and, alone, 2
    assert jaccard.connected(path, True)[0].tolist() == [0, 0, -1, 0]
    assert [x.tolist() for x in jaccard.connected(path[:2, 2:], False)] == [[-1, 1], [-1, 1]]


def test_visits_of_nearly_similar_texts(docs, monkeypatch):
    """Texts that are mostly just below the threshold do not visit each other one by one."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    made, visits = [], jaccard._visits
    monkeypatch.setattr(jaccard, "_visits", lambda *x: made.append(visits(*x)) or made[-1])
    monkeypatch.setattr(jaccard, "dropped", lambda *x: None)
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.join(docs(rows)).collect()}
    each = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    links = [[j for j in range(160) if j != i and 100 * len(each[i] & each[j]) >= 75 * len(each[i] | each[j])] for i in range(160)]
    least = list(range(160))
    for _ in rows:
        least = [min(least[j] for j in [i, *links[i]]) for i in range(160)]
    assert got == {i: (len(links[i]), least[i]) for i in range(160)}
    assert made[0].count() <= 4 * len(rows)


def test_jaccard_of_nothing(docs):
    assert jaccard.join(docs([])).count() == 0
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.join(docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (7, "A b")])).collect())
    assert got == [(-1, 3), (1, 1), (2, 2), (3, 3), (3, 3), (7, 3)]


@pytest.mark.parametrize("block, stars", [(1024, 2), (3, 2), (3, 0)])
def test_links(docs, monkeypatch, block, stars):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = [*TEXTS, (None, "one"), (3, "one"), (90, "a b"), (90, "c d"), (91, "A  b")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    want = [sum(100 * len(a & b) >= 75 * len(a | b) > 0 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = jaccard.join(docs(rows), stars=stars).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.n_links) for r in got) == sorted((i or -1, len(a), n) for (i, _), a, n in zip(rows, sets, want, strict=True))
    assert sum(want) > 2 * len({r.class_id for r in got})  # far more than a link a class


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1)])
def test_links_of_an_id_with_several_texts(docs, order):
    """An unrelated text of the same id, wherever it stands, takes no link away."""
    a, unrelated = prose(60), prose(50)
    rows = [(1, a), (5, unrelated), (5, a + " more")]
    got = jaccard.join(docs([rows[k] for k in order]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (5, 1, 1), (5, 5, 0)]


def test_links_of_random_rows_with_repeated_ids(docs):
    r = random.Random(0)
    base = [prose(r.randint(4, 80)) for _ in range(6)]
    rows = [(r.randrange(8), None if r.random() < 0.1 else " ".join([*w[: len(w) - r.randint(0, 3)], *r.choice(([], ["x"], ["y", "z"]))])) for w in (r.choice(base).split() for _ in range(60))]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    links = [[j for j, b in enumerate(sets) if 100 * len(a & b) >= 75 * len(a | b) > 0] for a in sets]
    want = []
    for i, (d, _) in enumerate(rows):
        reached, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in reached:
                    reached.add(j)
                    stack.append(j)
        want.append((d, len(sets[i]), min(rows[j][0] for j in reached), max(0, len(links[i]) - 1)))
    got = jaccard.join(docs(rows).repartition(3)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in got) == sorted(want)


def test_overlaps():
    a, b = ([np.array(sorted(random.sample(range(300), random.randint(1, 200))), np.uint64) for _ in range(9)] for _ in range(2))
    for other, got in ((b, jaccard.overlaps(a, b, 7)), (a, jaccard.overlaps(a, None, 64))):
        assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in other] for x in a]


def test_prefixes_meet():
    levels = np.random.default_rng(1).integers(0, 3, 1 << jaccard.LEVEL_BITS).astype(np.uint8)
    for _ in range(200):
        a = set(random.sample(range(1 << 40), random.randint(1, 60)))
        b = set(random.sample(sorted(a), max(1, int(len(a) * 0.9)))) | {random.randrange(1 << 40) for _ in range(random.randint(0, 3))}
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = (np.array(sorted(s), np.uint64) << np.uint64(20) for s in (a, b))
            for o in jaccard.ORDERS:
                p, q = (jaccard.prefix(s, levels, o, 75) for s in (x, y))
                assert set(p) & set(q) and len(p) == jaccard.prefix_size(len(x), 75)
            x, y = (jaccard.Guest(0, 1, h, len(s), [jaccard.prefix(s, levels, o, 75).astype(np.uint16) for o in jaccard.ORDERS]) for h, s in ((True, x), (False, y)))
            assert jaccard.may_be_similar([x], [y], 75).all() and jaccard.may_be_similar([x, y], None, 75).all()


# --- decontamination


def plain_report(rows, items):
    import re

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    out = {}
    for i, t in rows:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            v = cut(text)
            n = min(10, len(v))
            spans = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in spans:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, docs):
    passage = prose(14)
    items = [(1, passage), (2, "Émile  a-b c"), (3, ""), (4, None), (10, passage + " " + prose(20)), (5, "lone"), (6, prose(12))]
    rows = [(0, None), (1, ""), (2, passage), (3, prose(50) + " " + passage.upper() + "! " + prose(9) + " " + passage), (4, prose(20) + " émile A b, C émile a b c"), (5, "ÉMILE a b c Émile a b c"), (6, "x Lone lone"), (7, prose(400)), (8, " ".join(passage.split()[:9])), (9, " ".join(passage.split()[2:12]))]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(spark, docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_report(rows, items)


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontamination.report(spark, docs([(1, "a b")]), none).collect()] == [(2, 0)]
    assert decontamination.report(spark, docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# --- search


@pytest.mark.parametrize("settings", [{}, {"shard_bytes": 2000}, {"most_terms": 50, "k": 3}])
def test_search(docs, settings):
    k, w = settings.get("k", 10), {i: Counter(words(t)) for i, t in TEXTS}
    n, mean = len(w), sum(sum(c.values()) for c in w.values()) / len(w)
    df = Counter(x for c in w.values() for x in c)
    table = docs(TEXTS)
    found = defaultdict(list)
    for r in search.search(table, table.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id"), **settings).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    for q in range(0, n, 4):
        scores = []
        for i, c in w.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in w[q] if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        want = sorted(scores)[:k]
        assert [i for i, _ in found[q]] == [i for _, i in want]
        assert [s for _, s in found[q]] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_search_of_an_id_with_several_rows(docs):
    table = docs([(i, prose(30)) for i in range(40)])
    got = lambda *rows: [(r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(table, docs(list(rows)).withColumnRenamed("doc_id", "query_id"), k=4).orderBy("query_id", "rank").collect()]
    a, b = prose(6), prose(6)
    assert got((1, a), (1, a), (2, b)) == got((1, a), (2, b)) and len({d for _, _, d, _ in got((1, a), (1, a))}) == 4
    assert got((1, a), (1, b)) == got((1, a + " " + b))


def test_search_of_nothing(docs):
    none = docs([])
    assert search.search(none, none.withColumnRenamed("doc_id", "query_id")).count() == 0
    some = docs([(1, "a"), (2, None), (None, "a")])
    assert [(r.query_id, r.doc_id) for r in search.search(some, some.withColumnRenamed("doc_id", "query_id")).collect()] == [(1, 1)]


def test_report_of_null_ids(spark, docs):
    passage = " ".join(f"word{k}" for k in range(14))
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    d = docs([(None, f"before {passage} after"), (None, "a clean text"), (1, passage), (1, "clean too")])
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontamination.report(spark, d, items).collect())
    assert got == [(0, 3, 0, False), (0, 16, 14, True), (1, 2, 0, False), (1, 14, 14, True)]
    left = decontamination.clean(spark, d, items)
    assert left.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "a clean text"), (1, "clean too")]


def test_items_without_an_id_are_not_passed_over_where_texts_are_dropped(spark, docs):
    passages = [" ".join(f"{w}{k}" for k in range(n)) for w, n in (("long", 14), ("brief", 4), ("known", 12), ("other", 12))]
    items = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (5, passages[2]), (5, passages[3]), (None, None), (None, "")], "item_id long, text string")
    d = docs([*((k, f"before {p} after") for k, p in enumerate(passages)), (8, "a clean text"), (9, None)])
    assert sorted(r.doc_id for r in decontamination.clean(spark, d, items).collect()) == [8, 9]


def test_shards_of_very_many_short_texts(docs, monkeypatch):
    """A shard ends at a number of texts as well, whatever few bytes they have."""
    sizes, make = [], search.Shard.__init__
    rows = [(i, random.choice(VOCABULARY)[:2]) for i in range(900)]
    table = docs(rows).coalesce(1)
    asked = table.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, search.search(table, asked).collect()))
    assert sorted(map(tuple, search.search(table, asked, shard_texts=40).collect())) == want and want
    q = search.Queries([1], [np.array([1], np.uint64)])
    monkeypatch.setattr(search.Shard, "__init__", lambda self, ids, *a, **k: sizes.append(len(ids)) or make(self, ids, *a, **k))
    shard = search.Shard(np.arange(8192), np.ones(8192, np.int64), np.arange(8192), np.zeros(8192, np.int64), 1, np.ones(1), 1.0)
    best = next(shard.best(q, 0, 1, 10, np.zeros(1)))
    assert sizes == [8192] and best[1].tolist() == list(range(10))


def test_queries_with_the_same_common_words_share_batches():
    rng = np.random.default_rng(3)
    names = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    some = lambda i, n: np.append(rng.choice(names[200 * (i % 2) :][:200], n), names[200 * (i % 2)])  # all texts of a language have its first word
    terms = [np.unique(some(i, 30)) for i in range(60)]
    q = search.Queries(list(range(60)), terms)
    known = {h: i for i, h in enumerate(q.vocabulary.tolist())}
    asked = np.concatenate([names, rng.integers(1, 1 << 63, 5000, dtype=np.uint64), q.vocabulary + np.uint64(len(q.table))])  # the last ones start at places that are taken
    assert q.places(asked).tolist() == [known.get(h, -1) for h in asked.tolist()]
    assert search.Queries([], []).places(asked).tolist() == [-1] * len(asked)
    doc = np.repeat(np.arange(900), 26)
    term = q.places(np.concatenate([some(i, 25) for i in range(900)]))
    doc, term = doc[term >= 0], term[term >= 0]
    df = np.bincount(np.unique(term * 900 + doc) // 900, minlength=len(q.vocabulary))
    idf = np.log(1 + (900 - df + 0.5) / (df + 0.5))
    near = q.alike(idf)
    assert sorted(near.ids.tolist()) == list(range(60)) and len(set((near.ids[:30] % 2).tolist())) == len(set((near.ids[30:] % 2).tolist())) == 1
    shard = search.Shard(np.arange(900), np.full(900, 26), doc, term, len(q.vocabulary), idf, 26.0)
    got = [{int(x.ids[i]): (p.tolist(), np.round(v, 5).tolist()) for a in (0, 30) for i, p, v in shard.best(x, a, a + 30, 10, np.zeros(30))} for x in (q, near)]
    assert got[0] == got[1] and all(len(p) == 10 for p, _ in got[0].values())
