import random

import numpy as np
import pytest
import xxhash

from twinsift.llm import simhash, vectors


def closure(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").encode().split() for w in [w.decode()]]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("the of Été foo bar baz qux tion ing er".split()) + str(rng.randrange(50)) for _ in range(120)) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + base[:5] + [None, "", "  \n", "one", "ONE", "one two", "a b c", "A\tB  c", "x " * 5000]


def test_near_duplicates_against_brute_force(spark):
    found = texts()
    ids = list(range(100, 100 + len(found)))
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in zip(ids, found)] + [(100, found[0], "again", 2)], "doc_id long, text string, fp string, component_id int")
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    fps = [brute_fingerprint(t) for t in found]
    roots = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = [(i, f, ids[r]) for i, f, r in zip(ids, fps, roots)]
    assert sorted(got) == sorted(want + [want[0]])
    kept = simhash.keep_one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_different_texts_under_one_id_are_all_kept(spark):
    first, second = "one two three four five six", "quite another text with other words in it"
    rows = [(1, first, "a"), (1, second, "b"), (1, second, "c"), (2, first, "d"), (None, first, "e")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", first), ("1", second), ("None", first)])


def test_each_component_keeps_one_row_whatever_ids_and_columns_repeat(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(3, base, 1, "x"), (7, base, 2, "x"), (7, "a text that no other row has", 3, "y"), (7, "a text that no other row has", 3, "y"), (7, "a text that no other row has", 4, "y"), (2**60 + 1, "one", 5, "z"), (2**60 + 2, "two", 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, row string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"], r["text"], r["key"], r["row"]) for r in kept.collect())
    third = [r for r in got if r[0] == 7]
    assert len(got) == 4 and (3, base, 1, "x") in got and len(third) == 1 and third[0][:2] == (7, "a text that no other row has")
    assert {r[0] for r in got} == {3, 7, 2**60 + 1, 2**60 + 2}


def test_null_and_repeated_ids_of_fingerprints(spark):
    rows = [(None, "one two three"), (9, "one two three"), (None, "alone with no id"), (4, "four"), (4, "five")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, 9), (9, 9), (None, None), (4, 4), (4, 4)], key=str)


def test_links_come_from_the_trees(monkeypatch):
    """Without the trees' edges no link is found: nothing else unites fingerprints."""
    rng = np.random.default_rng(6)
    fps = np.sort(np.unique(np.r_[rng.integers(0, 2**63, 300, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    shard = np.zeros(len(fps), dtype=np.int64)
    label = closure(len(fps), [tuple(p) for p in simhash.link_shards(fps, shard).tolist()])
    assert label == closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3])
    monkeypatch.setattr(simhash, "build_trees", lambda f, s: (np.full(len(f), -1), np.zeros(len(f), dtype=np.int64), np.zeros(len(f), dtype=np.int64)))
    assert not len(simhash.link_shards(fps, shard))


def test_kernel_and_columns_agree_on_xxhash(spark):
    assert xxhash.xxh64("a b c".encode(), seed=42).intdigest() == spark.sql("select xxhash64('a b c') h").first()["h"] % 2**64


@pytest.mark.parametrize("limit", [1024, 8])
def test_links_of_dense_groups(spark, monkeypatch, limit):
    """Many fingerprints around one centre: every component is found, also where shards are split again."""
    monkeypatch.setattr(simhash, "SPLIT_SHARD", limit)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:3]:
        for _ in range(150):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps) | {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    pairs = [(at[r["u"]], at[r["v"]]) for r in got]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert closure(len(fps), pairs) == closure(len(fps), brute)


def test_tree_keys_are_distances():
    rng = np.random.default_rng(3)
    fps, shard = rng.integers(0, 2**63, 300, dtype=np.uint64), np.sort(rng.integers(0, 5, 300))
    parent, key, _ = simhash.build_trees(fps, shard)
    kids = np.flatnonzero(parent >= 0)
    assert (shard[kids] == shard[parent[kids]]).all() and len(np.unique(shard)) == (parent < 0).sum()
    assert (key[kids] == np.bitwise_count(fps[kids] ^ fps[parent[kids]])).all()
    assert len({(p, k) for p, k in zip(parent[kids], key[kids])}) == len(kids)


def vector_rows(seed=5, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    near = x[:60] + 0.05 * rng.standard_normal((60, dims)).astype(np.float32) * np.linalg.norm(x[:60], axis=1, keepdims=True) / 4
    x = np.concatenate([x, near.astype(np.float32), x[:30] * 2, x[5:6].repeat(40, axis=0)])
    return x, rng.integers(0, 3, len(x))


def brute_vectors(rows, cosine=0.98):
    n = len(rows)
    links = [0] * n
    pairs = []
    ok = lambda v: v is not None and all(e is not None and np.isfinite(e) for e in v) and any(e != 0 for e in v)
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is None or a != b or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            v, w = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
            if v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return links, closure(n, pairs)


@pytest.mark.parametrize("block, per_centroid", [(2048, 4), (16, 4), (2048, 60)])
def test_vectors_against_brute_force(spark, monkeypatch, block, per_centroid):
    """Whole lists, lists in blocks, and lists that a second level splits."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LIST_ROWS", 30 if per_centroid == 4 else 10)
    monkeypatch.setattr(vectors, "SAMPLE_PER_CENTROID", per_centroid)
    x, labels = vector_rows()
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels))]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, x[0].tolist(), None), (2001, x[0].tolist(), None)]
    rows += [(3000 + i, [1.0, 2.0, 0.01 * i], 0) for i in range(3)]  # other dimensions, filled up inside, are compared with their like alone
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(df).collect()}
    links, roots = brute_vectors(rows)
    want = {r[0]: (n, rows[c][0], c == i) for i, (r, n, c) in enumerate(zip(rows, links, roots))}
    wrong = [k for k in want if got[k] != want[k]]
    assert len(got) == len(want) and not wrong
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_repeated_and_null_ids(spark):
    rows = [(2**60 + 1, [1.0, 0.0], 1), (2**60 + 2, [1.0, 0.001], 1), (2**60 + 1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (None, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in vectors.near_duplicate_vectors(df).collect()), key=repr)
    low = 2**60 + 1
    assert got == sorted([(low, 2, low, True), (low + 1, 2, low, False), (low, 0, low, True), (None, 2, low, False), (None, 0, None, True)], key=repr)


def test_a_dense_block_takes_bounded_memory():
    """2,048 different vectors that all link with each other: counts are whole, and the pairs are never held together."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.standard_normal(64) + 0.01 * rng.standard_normal((vectors.BLOCK, 64))
    index = vectors.fit_index(vectors._unit(x), 200)
    side = vectors.Side(np.arange(len(x)), x, np.ones(len(x)), np.zeros(len(x), dtype=np.int64))
    tracemalloc.start()
    gained_q, gained_x, forest = vectors.block_links(index, 0.98, 0, side, np.zeros(0, dtype=np.int64), side)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (gained_q == len(x) - 1).all() and not gained_x.any() and forest.shape == (2, len(x) - 1)
    assert most < 300e6, most


def test_lookup_distance_is_the_codes_distance():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.fit_index(x, 4000)
    here = x[:50] - index.centroids[0]
    codes, error = index.encode(here)
    back = np.concatenate([b[codes[:, m]] for m, b in enumerate(index.books)], axis=1)
    assert np.allclose(np.linalg.norm(here - back, axis=1), error)
    assert np.allclose(index.lookup(here[:7], codes), np.linalg.norm(here[:7, None] - back[None], axis=2), atol=1e-4)
