import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from twinsift.llm import block_max, exact, whitening

VECTORS = "vec_id long, embedding array<float>, n string, component string"


def brute_whitening(vectors, k):
    width = max({len(v) for v in vectors}, key=lambda w: (sum(len(v) == w for v in vectors), w))
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors if len(v) == width], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array((n * x - s) / n, dtype=float)
    v = centred.T @ centred / n
    values, parts = np.linalg.eigh(v)
    k = min(k, int((values > 1e-10 * values[-1]).sum()))
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ (parts / np.sqrt(values)), values / np.trace(v)


def check_whitening(spark, rows, k=8):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    got = {}
    for r in whitening.whitened(df, k).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max({len(v) for _, v in usable}, key=lambda w: (sum(len(v) == w for _, v in usable), w))
    usable = [(i, v) for i, v in usable if len(v) == width]
    n, deviation, want, explained = brute_whitening([v for _, v in usable], k)
    assert sorted(got) == sorted(i for i, _ in usable)
    for j in range(want.shape[1]):
        mine = np.array([got[i][j + 1]["whitened"] for i, _ in usable])
        sign = np.sign(mine @ want[:, j])
        assert np.allclose(mine, sign * want[:, j], atol=1e-7)
    for (i, _), d in zip(usable, deviation):
        assert len(got[i]) == want.shape[1] and all(r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-9 for r in got[i].values())
    assert np.allclose([got[usable[0][0]][j + 1]["explained"] for j in range(want.shape[1])], explained, rtol=1e-9)


@pytest.mark.parametrize("dims,rows", [(24, 300), (100, 400), (5, 60), (1, 9), (40, 12)])
def test_whitening_against_a_dense_solver(spark, dims, rows):
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((rows, dims)).astype(np.float32)
    found = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    odd = [(-1, None), (-2, []), (-3, [None] * dims), (-4, [float("nan")] * dims), (-5, [float("inf")] + [0.0] * (dims - 1)), (-6, [1.0] * (dims + 1))]
    check_whitening(spark, found + odd)


def test_whitening_of_flat_and_steep_spectra():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    for values in (np.linspace(2, 1, 200), np.r_[np.ones(8) + np.arange(8)[::-1] * 1e-3, np.linspace(0.99, 0.5, 192)], 10.0 ** -np.arange(200.0), np.r_[np.ones(3), np.zeros(197)]):
        m = (q * values) @ q.T
        calls = []
        found, parts = whitening.principal_components(lambda b: calls.append(1) or m @ b, 200, 8)
        real = np.sort(values)[::-1][: len(found)]
        assert len(found) == min(8, int((values > 1e-13).sum())) and np.allclose(found, real, rtol=1e-10)
        assert np.linalg.norm(m @ parts - parts * found, axis=0).max() < 1e-12 and np.allclose(parts.T @ parts, np.eye(len(found)), atol=1e-12)
        assert len(calls) <= 20


def test_whitening_restarts_when_it_may_keep_few_blocks():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.geomspace(1e4, 1, 300)
    m = (q * values) @ q.T
    found, _ = whitening.principal_components(lambda b: m @ b, 300, 4, extra=4, kept=4)
    assert np.allclose(found, values[:4], rtol=1e-10)


def test_whitening_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened(none).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], "", "")] * 5, VECTORS)
    assert whitening.whitened(same).count() == 0  # no variance
    rows = [(None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [3e30, 0.0]), (9, [5.0, -2.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in rows], VECTORS)).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in got) == sorted([(i, c) for i in (-1, 7, 7, 9) for c in (1, 2)])
    wide = [(i, [float(2**40 * (i % 3)), float(i)]) for i in range(6)]  # deviations beyond 64 bits, sums beyond a fast path
    got = whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in wide], VECTORS)).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] % 3 != 1)


def brute_owners(rows):
    text = {k: re.sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode()) for k, (_, t) in enumerate(rows)}
    groups = {}
    for k, t in text.items():
        groups.setdefault(t, []).append(rows[k][0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(groups[text[k]]), len(groups[text[k]]), i == least(groups[text[k]]), hashlib.sha256(text[k]).hexdigest()) for k, (i, _) in enumerate(rows)), key=str)


def documents(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é\t\n") for _ in range(rng.randrange(30))) for _ in range(80)]
    texts = base + [t.replace(" ", "  ") for t in base] + ["hot text"] * 150 + ["hot\x0btext", "hot \r\ntext", " hot text", "hot text", None, "", " ", "\n", "long " * 40_000, "long " * 40_000 + "x", "long\t" * 40_000]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, "hot text"), (None, "hot text"), (None, "alone"), (None, "alone")]


@pytest.mark.parametrize("held,handed", [(exact.HELD, exact.HANDED), (6000, 2000)])
def test_exact_duplicates_against_brute_force(spark, monkeypatch, held, handed):
    def small(f):  # the budgets reach the workers inside the function
        def run(batches):
            from twinsift.llm import exact as module

            module.HELD, module.HANDED = held, handed
            yield from f(batches)

        return run

    monkeypatch.setattr(exact, "combine", small(exact.combine))
    monkeypatch.setattr(exact, "own", small(exact.own))
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, low int, sha string")
    got = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact.exact_duplicates(df).collect()]
    want = brute_owners(rows)
    assert sorted(got, key=str) == [(i, k, n, True if i is None and k is None else s, h) for i, k, n, s, h in want]
    kept = exact.keep_first_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in got if r[3])
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_tries_hold_spill_and_refuse():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))) for _ in range(3000)]
    trie, seen = exact.Trie(), {}
    for t in texts:
        trie.find(t, lambda: [0])[0] += 1
        seen[t] = seen.get(t, 0) + 1
    assert {t: e[0] for t, e in exact.Trie.below(trie.root)} == seen and trie.texts == len(seen)
    while trie.texts > 1:
        gone = dict(trie.spill())
        left = dict(exact.Trie.below(trie.root))
        assert gone and not gone.keys() & left.keys() and len(left) == trie.texts
        assert all(trie.find(t, lambda: pytest.fail("a new node below a spilled prefix")) is None for t in gone)
        assert all(trie.find(t, list) == seen_end for t, seen_end in left.items())
    a = bytes(range(256)) * 50
    for at in (0, 1, 7, 8, 9, 5000, len(a) - 1):
        b = a[:at] + bytes([a[at] ^ 1]) + a[at + 1 :]
        assert exact.shared_bytes(a, b"zz" + b, 2) == at and exact.shared_bytes(a, b[: at + 1], 0) == at
    assert exact.shared_bytes(a, a[:100], 0) == 100


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in term.findall(t or "")]
    found = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    out = []
    for item, text in items:
        scores = []
        for i, words in found:
            score = 0
            for t in set(split(text)) if words else ():
                df = sum(t in w for _, w in found)
                w, tf, m = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))), words.count(t), 10 + 90 * len(words) * n // total
                score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,queries", [(64, 20_000), (3, 2)])
def test_search_against_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(block_max, "QUERIES", queries)
    rng = random.Random(block)
    words = ["Été", "x1", "foo", "BAR", "ba'r", "q-q", "naïve", "the", "of", "and"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(180)]
    docs += [(500 + i, "the w1 w2 rare") for i in range(40)] + [(3, docs[3][1]), (None, "rare the"), (900, None), (901, ""), (902, " -- \n"), (903, "w1 " * 30_000)]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for j in range(7)] + [(50, "rare w1 w2"), (50, "RARE"), (51, "nowhere"), (52, None), (53, "!?"), (None, "été the")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    run = block_max.forward_blocks.__globals__
    monkeypatch.setitem(run, "BLOCK", block)
    got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in block_max.ranked(d, q, 5).collect()]
    assert sorted(got, key=str) == brute_search(docs, items, 5)
    assert block_max.ranked(d.limit(0), q).count() == 0 and block_max.ranked(d, q.limit(0)).count() == 0
    assert block_max.ranked(d.where("doc_id in (900, 901, 902)"), q).count() == 0


def test_bounds_never_fall_below_scores():
    rng = np.random.default_rng(7)
    terms = np.array([2, 5, 9])
    block = block_max.Block(list(range(4)), terms, np.array([0, 3, 4, 6]), np.array([0, 1, 3, 2, 0, 3]), rng.integers(1, 100, 6))
    most = np.array([block.impacts[:3].max(), block.impacts[3], block.impacts[4:].max()])
    q = block_max.Queries([0, 1, 2], pa.array(list("abcdefghij")), np.array([2, 5, 1, 9, 9]), np.array([0, 3, 4, 5]), np.array([3, 4, 5, 6, 7]))
    for i, bound in enumerate(q.bounds(terms, most)):
        assert block.scores(*q.of(i)).max() <= bound
    assert block.scores(np.array([1, 3]), np.array([1, 1])).max() == 0
