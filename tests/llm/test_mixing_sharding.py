import random
import zlib

import pytest

from twinsift.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([3, 10, 30, 90])))
        source = "big" if i % 3 == 0 else rng.choice(["a", "b", "c", "é", None])
        rows.append((i, text, rng.choice(["en", "fr", None]), source, len(text)))
    return rows


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def size_of(text):
    return len((text or "").encode().split())


def test_mix_meets_targets(spark):
    rows = corpus() + [(500, None, None, "a", 0), (501, "", "en", "only-empty", 0), (502, "x y", "en", None, 0), (None, "p q r", "en", "c", 0), (7, "dup " * 9, "en", "b", 1), (7, "dup " * 9, "en", "b", 1)]
    df = spark.createDataFrame([(*r, 9, 9.0) for r in rows], DOCS + ", size int, target double")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    want = brute_targets(sizes)
    by_key = {}
    for i, text, _, source, _ in rows:
        by_key.setdefault((i, size_of(text)), source)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = by_key[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 10, (s, taken[s], want[s])
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    repeated = mixing.repeat_documents(df, mixing.mix_sources(df))
    assert repeated.columns == df.columns
    assert sum(size_of(r["text"]) for r in repeated.collect()) == sum(taken.values())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame(corpus(), DOCS).limit(0)
    assert mixing.mix_sources(df).count() == 0


def brute_sample(rows, goal):
    """In order of rank: a first run up to the document that exceeds the goal, then twice what fits of the rest."""
    order = sorted((r for r in rows if r["inclusion"] > 0), key=lambda r: (r["_rank"], r["_key"], r["_copy"]))
    chosen, left = set(), goal
    for _ in range(mixing.ROUNDS):
        want = left
        for r in [r for r in order if (r["_key"], r["_copy"]) not in chosen and r["size"] <= want]:
            if r["size"] > left:
                break
            chosen.add((r["_key"], r["_copy"]))
            left -= r["size"]
    return chosen


def test_the_sample_against_a_brute_force_sampler(spark):
    """Probabilities are proportional to the square root of the size, 1 where that exceeds it, and expect the goal; the choice follows the ranks."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([2, 5, 20, 60, 400]), "en", "ab"[i % 2], 0) for i in range(600)] + [(1000, "w " * 9000, "en", "c", 0), (1001, "w " * 3000, "en", "c", 0), (1002, "w " * 10, "en", "c", 0)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), share=0.7).collect()
    source = {i: s for i, _, _, s, _ in rows}
    seen = set()
    for s in "abc":
        own = [r for r in got if source[r["doc_id"]] == s]
        target, total = own[0]["target"], own[0]["source_size"]
        goal = target - int(target / total + 1e-12) * total
        fit = [r for r in own if r["size"] <= goal]
        low, high = 0.0, 1.0
        for _ in range(100):
            theta = (low + high) / 2
            low, high = (theta, high) if sum(min(1, theta * r["size"] ** 0.5) * r["size"] for r in fit) < goal else (low, theta)
        for r in own:
            want = min(1, low * r["size"] ** 0.5) if r["size"] <= goal else 0
            assert abs(r["inclusion"] - want) < 0.1 * want + 1e-9, (s, r, want)
            seen.add(round(r["inclusion"], 3))
        whole = int(target / total + 1e-12)
        assert {(r["_key"], r["_copy"]) for r in own if r["copies"] > whole} == brute_sample(own, goal)
    assert len(seen) > 6  # documents of one source have their own probabilities


def test_rows_alike_in_id_and_text_keep_their_other_columns(spark):
    rows = [("x", "en", "a b c", "s", 1), ("y", "fr", "a b c", "s", 2), ("z", "fr", "d e f", "t", 3)] * 2
    df = spark.createDataFrame([(1, t, lang, s, n, again, again) for again, lang, t, s, n in rows], DOCS + ", _key string, _again string")
    got = mixing.repeat_documents(df, mixing.mix_sources(df, weights=(1.0,), share=2.0))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in df.collect() for _ in (0, 1))


def test_very_long_and_empty_documents_are_placed(spark):
    rows = [(i, "w" * 2_000_000 if i == 0 else "" if i % 2 else None, None, None, 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    placed, mixed = sharding.assign_shards(df, 4).collect(), mixing.mix_sources(df).collect()
    assert len(placed) == len(mixed) == 40 and max(r["size"] for r in placed) == 2_000_001 and {r["taken"] for r in mixed} <= {0, 1, 2}


def test_sources_are_told_apart_by_their_whole_names(spark):
    rows = [(i, f"some words {i} here", "en", f"https://example.org/a/long/name/{'ab'[i % 2]}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    points = {r["_group"]: r["_source"] for r in sharding._points(sharding.text_groups(df)).collect()}
    side = {r["_group"]: r["source"] for r in df.select("source", sharding._group()).collect()}
    a, b = ([v for g, v in points.items() if side[g].endswith(x)] for x in "ab")
    assert max(a) < min(b) and sharding.DIMENSIONS[2] == "_source"


def test_small_odds_lose(spark):
    """Preference raises inclusion: documents with higher odds are taken more often."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "w " * 10, "en", "s" if i % 2 else "t", 0) for i in range(400)], DOCS)
    got = mixing.mix_sources(df, share=0.5, preference=F.when(F.col("doc_id") < 200, 20.0).otherwise(1.0)).collect()
    low, high = (sum(r["copies"] for r in got if (r["doc_id"] < 200) == flag) for flag in (False, True))
    assert high > 1.3 * low


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_shards_are_near_equal_and_gapless(spark, shards):
    rows = corpus(600) + [(1000 + i, "copy of the same text", "en", f"s{i}", 0) for i in range(12)] + [(2000, None, None, None, 0), (2001, None, "en", "a", 0), (2002, "", "en", "a", 0), (None, "nul id", "en", "a", 0), (5, "again", "en", "a", 0), (5, "again", "en", "a", 0)]
    df = spark.createDataFrame([(*r, 99) for r in rows], DOCS + ", shard int")
    got = sharding.assign_shards(df, shards).collect()
    assert len(got) == len(rows)
    total, groups = [0] * shards, {}
    for r in got:
        total[r["shard"]] += r["size"]
    facts = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert facts == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots
    mean = sum(total) / shards
    assert max(abs(t - mean) for t in total) < 0.2 * mean
    for r in got:
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())
    again = sharding.assign_shards(df.repartition(5), shards).collect()
    assert sorted((str(r["doc_id"]), r["shard"]) for r in got) == sorted((str(r["doc_id"]), r["shard"]) for r in again)


def test_shards_of_nothing_and_of_one_text(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    assert sharding.assign_shards(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "one", "en", "s", 3) for i in range(50)], DOCS)
    got = sharding.assign_shards(same).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(50))


def test_splits_share_the_bytes_along_the_widest_dimension(spark):
    """Every split replayed over all points: the dimension, the weighted median, and the leaf of each point."""
    df = spark.createDataFrame(corpus(700, seed=8), DOCS)
    points = sharding._points(sharding.text_groups(df))
    leaves, splits = sharding.kd_tree(points, 16)
    inside, shards = {0: points.collect()}, {0: 16}
    for k, split in enumerate(splits):
        rows, n = inside.pop(split.node), shards.pop(split.node)
        width = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in sharding.DIMENSIONS}
        assert width[split.dimension] == max(width.values())
        left, right = [r for r in rows if r[split.dimension] < split.at], [r for r in rows if r[split.dimension] >= split.at]
        goal = sum(r["_bytes"] for r in rows) * (n // 2) / n
        assert abs(sum(r["_bytes"] for r in left) - goal) <= max(r["_bytes"] for r in rows)
        inside[2 * k + 1], inside[2 * k + 2] = left, right
        shards[2 * k + 1], shards[2 * k + 2] = n // 2, n - n // 2
    assert len(splits) == 15 and set(shards.values()) == {1}
    placed = {r["_group"]: r["shard"] for r in leaves.collect()}
    of_leaf = [{placed[r["_group"]] for r in rows} for rows in inside.values()]
    assert all(len(s) == 1 for s in of_leaf) and set().union(*of_leaf) == set(range(16))


def test_one_source_with_most_rows_is_split(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(20)), "en", "hot", 1) for i in range(800)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS)).collect()
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(total) < 1.1 * sum(total) / 16


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame(corpus(60), DOCS)
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(back, str(tmp_path / "t"), 4)
    sharding.write_shards(back, str(tmp_path / "t"), 4, folder="part")
    again = spark.read.parquet(str(tmp_path / "t"))
    assert again.count() == 60 and (again.where("part = shard").count() == 60)
    assert back.count() == 60 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
