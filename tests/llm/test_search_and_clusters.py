"""Delta Lloyd, treap search and SimHash against plain versions and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import lloyd, simhash, treaps

DOCS = "doc_id long, text string, lang string, fp long, term string, key string, score long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "k", 2) for i, t in rows], DOCS)


LONG = "Word and " * 40_000 + "x" * 50_000
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, LONG), (4, "same text here for all of us"), (5, "same text here for all of us"), (None, "same text here for all of us"), (6, "Ünï ✓ 😀 émoji"), (0, None), (4, "same text here for all of us"), (None, "one two")]


# SimHash


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=4):
    """rows (doc_id, fingerprint): the least id reachable from each."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                up[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return Counter((i, f"{f:016x}", least.get(top(f))) for i, f in rows)


def test_simhash_on_odd_and_near_texts(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(12)]
    near = []
    for k, t in enumerate(base):
        for j in range(6):
            w = t.split()
            w[rnd.randrange(300)] = rnd.choice(words)
            near.append((100 + 10 * k + j, " ".join(w)))
    rows = ODD + near
    got = Counter(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()))
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert sum(1 for i, _, c in got if i is not None and i >= 100 and c < i) > 20
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def ball(rnd, n, flips):
    centre = rnd.getrandbits(64)
    out = {centre}
    while len(out) < n:
        out.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, flips))))
    return out


@pytest.mark.parametrize("part", [7, 2048])
def test_simhash_links_of_crowds_chains_and_zero(spark, part):
    rnd = random.Random(5)
    fps = ball(rnd, 400, 6) | {rnd.getrandbits(64) for _ in range(300)} | {0, 1, 3, 2**64 - 1, 2**63}
    step = rnd.getrandbits(64)
    for _ in range(40):  # a chain, each link four bits from the last
        step ^= sum(1 << b for b in rnd.sample(range(64), 4))
        fps.add(step)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    for blocks in (5, 7, 9):
        units = simhash.units_of(nodes, blocks, part=part)
        edges = simhash.verify(units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")).collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() > 0 for a, b in edges)
        from kgspark.llm._common import connected

        label = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        groups = {}
        for (f,) in signed:
            groups.setdefault(label.get(f, f), set()).add(f & (2**64 - 1))
        want = {}
        for (i, _, c), n in plain_components([(f, f) for f in fps]).items():
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    # Parts bound what meets in a unit.
    most = simhash.units_of(nodes, 7, part=part).groupBy("key", "a", "b").count().agg(F.max("count")).head()[0]
    assert most <= 400 if part == 2048 else most <= 60


def test_simhash_keys_find_every_close_pair():
    rnd = random.Random(9)
    for blocks in (5, 6, 7, 10):
        keys = simhash.masks(blocks)
        for _ in range(300):
            flip = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not m & flip for m in keys)
    assert [simhash.blocks_for(n) for n in (0, 1000, 10**6, 10**12)] == sorted(simhash.blocks_for(n) for n in (0, 1000, 10**6, 10**12))


# Delta Lloyd


def plain_lloyd(rows, clusters, rounds, dims):
    """rows (vec_id, components): the contract, every vector against every centroid each round."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        owners = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, owners, strict=True) if o == k]
            if mine:
                cents[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, k in found:
        total[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, k, d, total[k], sum(total.values()), sha[k]) for i, d, k in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, owner string")


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_lloyd_matches_plain_rounds(spark, scale):
    rnd = random.Random(7)
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(scale * (rnd.gauss(k % 5, 0.8))) for _ in range(4)]) for k in range(300)]
    rows += [(k, list(rows[k][1])) for k in range(40)] + [(1000 + k, list(rows[0][1])) for k in range(60)]  # repeats and ties
    rows += [(None, [0.5] * 4), (None, [0.25] * 4), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf")] * 4), (2006, [-0.0] * 4)]
    got = Counter(map(tuple, lloyd.digest(*lloyd.cluster(vectors(spark, rows), clusters=12, rounds=5, dims=4)).collect()))
    assert got == plain_lloyd(rows, 12, 5, 4)


def test_lloyd_with_few_vectors_and_none(spark):
    few = [(k, [float(k), 1.0]) for k in range(3)] + [(None, [9.0, 9.0]), (3, [1e30, 0.0])]
    got = Counter(map(tuple, lloyd.digest(*lloyd.cluster(vectors(spark, few), clusters=40, dims=2)).collect()))
    assert got == plain_lloyd(few[:4], 40, 5, 2)
    none = vectors(spark, [(1, None), (2, [1.0])])
    for v in (none, none.limit(0)):
        out = lloyd.digest(*lloyd.cluster(v))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lloyd_compares_only_what_has_moved():
    rnd = np.random.default_rng(1)
    cents, v = rnd.integers(-99, 99, (9, 8)), rnd.integers(-99, 99, (500, 8))
    owner, distance = lloyd._nearest(v, np.full(500, -1), np.zeros(500, np.int64), cents, np.arange(9))
    for _ in range(6):
        after = cents.copy()
        moved = np.unique(rnd.integers(0, 9, 3))
        after[moved] = rnd.integers(-99, 99, (len(moved), 8))
        owner, distance = lloyd._nearest(v, owner, distance, after, moved)
        d = ((v[:, None, :] - after[None]) ** 2).sum(axis=2)
        assert (owner == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        cents = after


# Treap search


def plain_search(rows, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, words(t)) for i, t in rows]
    n_docs, n_terms = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, w in found:
            tf = Counter(w)
            m = 10 + (90 * len(w) * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in ts if tf[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def test_treap_search_matches_full_scoring(spark):
    rnd = random.Random(11)
    vocabulary = [f"t{int(rnd.paretovariate(0.6))}" for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 5, 30, 200))))) for k in range(500)]
    rows += [(k, rows[k][1]) for k in range(20)] + [(900 + k, rows[3][1].upper()) for k in range(25)] + ODD  # repeats and ties
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 3, 20))))) for k in range(30)]
    items += [(5, "same text"), (40, None), (41, "nowhere-found"), (42, ""), (None, "same émoji"), (None, "word"), (43, LONG), (44, rows[3][1])]
    d, b = docs(spark, rows), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    want = plain_search(rows, items)
    for options in ({}, {"leaf": 1, "segment": 300}, {"leaf": 8, "block_bytes": 400}):
        assert sorted(map(tuple, treaps.search(d.repartition(3), b, **options).collect()), key=repr) == want, options
    assert treaps.search(d.limit(0), b).count() == 0 and treaps.search(d, b.limit(0)).count() == 0


def test_treap_traversal_skips_most_postings():
    rnd = np.random.default_rng(2)
    n = 20_000
    places = np.concatenate([np.sort(rnd.choice(n, 6000, replace=False)) for _ in range(3)])
    impacts = np.concatenate([np.minimum(rnd.pareto(1.5, 6000) * 1e5, 9e8).astype(np.int64) + 1 for _ in range(3)])
    s = treaps.Segment(list(range(n)), places, np.repeat([0, 1, 2], 6000), impacts)
    item = [(0, 3000), (1, 2000), (2, 1000)]
    total = np.zeros(n, np.int64)
    for t, w in item:
        np.add.at(total, places[6000 * t : 6000 * (t + 1)], w * impacts[6000 * t : 6000 * (t + 1)])
    want = sorted(((int(x), -k) for k, x in enumerate(total)), reverse=True)[:10]
    best = treaps.Best(10)
    seen = s.search(item, best, leaf=16)
    assert sorted(best.heap, reverse=True) == want and seen < 18_000 // 5
    # Equal impacts make no chain: the tree stays shallow.
    flat = treaps.Treap(np.arange(5000), np.full(5000, 7))
    depth, level = 0, [flat.root]
    while level:
        depth += 1
        level = [c for x in level for c in (flat.left[x], flat.right[x]) if c >= 0]
    assert depth < 60


# Line dedup: rows that repeat


def test_lines_of_many_equal_rows(spark):
    """20,000 equal rows of one document behind another one: each loses its lines, and no row holds them 20,000 times."""
    from kgspark.llm import lines

    text = "\n".join(f"line number {k} of the stock text here" for k in range(21))
    first = docs(spark, [(1, text)])
    many = spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    d = first.select("doc_id", "text").union(many)
    grouped = lines.repeats(d)
    assert grouped.distinct().count() == grouped.select("hi", "lo").distinct().count()
    out = lines.dedup(d).groupBy("doc_id", "n_lines", F.length("text").alias("n")).count().collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n"], r["count"]) for r in out) == [(1, 0, len(text), 1), (2, 21, 0, 20_000)]


# Chat: the log behind a table of turns


def test_a_made_log_folds_to_its_turns(spark):
    from kgspark.llm import chat

    rnd = random.Random(12)
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "a", "öß😀 <|x", LONG[:3000], "ab"])) for c in (1, 2, None) for _ in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of(turns)
    assert {r["op"] for r in log.select("op").distinct().collect()} == set(chat.OPS) and log.count() > 100 and log.distinct().count() < log.count()
    told = lambda events: sorted(map(str, chat.read_back(chat.render(chat.fold(events))).collect()))
    assert told(log.orderBy(F.rand(3))) == told(chat.events_of(turns))
    assert log.limit(0).count() == 0 and chat.log_of(turns.limit(0)).count() == 0
