import random

import pytest

from twinsift.operators import communities
from twinsift.operators.communities import louvain
from twinsift.operators.components import connected_components
from twinsift.operators.lsh import linear_edges, quadratic_edges, star_edges

ALL = [(a, e) for a in ("louvain", "walktrap", "labels") for e in ("linear", "quadratic")]


def split(spark, buckets, algorithm="louvain", edges="linear", kind="long", **parameters):
    """Communities of elements in buckets, as a set of sets."""
    members = spark.createDataFrame([(0, str(b), e) for b, es in buckets.items() for e in es], f"hashtable int, value string, doc {kind}").cache()
    found = communities.communities(linear_edges(members), connected_components(star_edges(members)), algorithm, edges, **parameters).collect()
    out = {}
    for r in found:
        out.setdefault(r["community"], set()).add(r["element"])
    assert all(c == min(v) for c, v in out.items())
    return sorted(map(sorted, out.values()))


def test_communities_reject_what_they_do_not_know(spark):
    none = spark.createDataFrame([], "doc string, hashtable int, value string, weight long")
    parts = spark.createDataFrame([], "node string, component string")
    with pytest.raises(ValueError, match="edges"):
        communities.communities(none, parts, edges="cubic")
    with pytest.raises(ValueError, match="algorithm"):
        communities.communities(none, parts, algorithm="other")
    for algorithm, edges in ALL:
        assert communities.communities(none, parts, algorithm, edges).count() == 0
    linear = spark.createDataFrame([("a", 0, "v", 3), ("b", 0, "v", 3), ("c", 0, "v", 3)], "doc string, hashtable int, value string, weight long")
    of = spark.createDataFrame([(d, "a") for d in "abc"], "node string, component string")
    for algorithm, edges in ALL:
        found = {(r["community"], r["element"]) for r in communities.communities(linear, of, algorithm, edges).collect()}
        assert found == {("a", e) for e in "abc"}, (algorithm, edges)


@pytest.mark.parametrize("algorithm,ids", [("louvain", [0, 1, 2, 3, 4]), ("walktrap", [0, 1, 2, 3, 4]), ("walktrap", [2, 3, 7, 8, 9]), ("walktrap", [0, 1, 5, 6, 7])])
def test_known_communities(spark, algorithm, ids):
    a, b, c, d, e = ids
    assert split(spark, {0: [a, b], 2: [b, c], 1: [d, e]}, algorithm) == sorted([[d, e], [a, b], [c]])


def test_buckets_of_any_size_are_communities_by_plain_pairs(spark):
    """Pairs are edges between elements, without vertices of their own."""
    buckets = {0: range(4), 1: range(10, 15), 2: range(20, 26)}
    for algorithm, edges in [("louvain", "quadratic"), ("walktrap", "quadratic"), ("labels", "linear")]:
        assert split(spark, buckets, algorithm, edges) == [sorted(b) for b in buckets.values()], (algorithm, edges)


def cliques(rng, count, size, links):
    buckets = {}
    for g in range(count):
        of = list(range(g * 100, g * 100 + size))
        for k in range(size):
            buckets[f"in{g}.{k}"] = rng.sample(of, size // 2)
        buckets[f"all{g}"] = of
    for k in range(links):
        g = rng.randrange(count - 1)
        buckets[f"out{k}"] = [g * 100 + rng.randrange(size), (g + 1) * 100 + rng.randrange(size)]
    return buckets


@pytest.mark.parametrize("edges", ["linear", "quadratic"])
def test_louvain_finds_planted_groups_and_components_do_not_matter_to_each_other(spark, edges):
    buckets = cliques(random.Random(4), 6, 8, 5)
    want = [list(range(g * 100, g * 100 + 8)) for g in range(6)]
    other = {f"x{k}": [5000 + k, 5001 + k] for k in range(30)} if edges == "linear" else {}
    assert [c for c in split(spark, buckets | other, "louvain", edges) if c[0] < 5000] == want


def modularity(edges, label):
    total = 2 * sum(w for _, _, w in edges)
    degree, inside = {}, 0
    for a, b, w in edges:
        inside += 2 * w * (label[a] == label[b])
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0) + w
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def test_louvain_is_as_good_as_walktrap(spark):
    rng = random.Random(8)
    edges = [(f"0{a}", f"0{b}", 1.0) for a in range(40) for b in range(a) if rng.random() < (0.5 if a // 10 == b // 10 else 0.03)]
    graph = spark.createDataFrame([("c", *e) for e in edges], "component string, a string, b string, weight double")
    quality = [modularity(edges, {r["u"]: r["label"] for r in found.collect()}) for found in (louvain(graph), communities._walktrap(graph))]
    assert quality[0] >= quality[1] - 0.02 and quality[0] > 0.4
    assert louvain(graph, resolution=8.0).select("label").distinct().count() > 6


def test_a_hub_is_dealt_out_and_has_no_limit(spark, monkeypatch):
    """One algorithm at every size: a component beyond walktrap's limit, with a bucket that many elements share."""
    monkeypatch.setattr(communities, "MOST", 50)
    monkeypatch.setattr(communities, "HOT", 7)
    buckets = {"hub": range(60), **{f"p{k}": [100 + k, 101 + k] for k in range(5)}, "bridge": [59, 100]}
    got = split(spark, buckets)
    assert sorted(e for c in got for e in c) == [*range(60), *range(100, 106)] and list(range(59)) == got[0][:59]
    with pytest.raises(ValueError, match="too large"):
        split(spark, buckets, "walktrap")


def test_pairs_are_counted_once(spark):
    members = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (1, "b", 1), (1, "b", 2)], "hashtable int, value string, doc long")
    parts = connected_components(star_edges(members))
    assert [tuple(r) for r in communities.graph_of(linear_edges(members), parts, "quadratic").collect()] == [(1, "01", "02", 1.0)]
    assert quadratic_edges(members).collect()[0]["bands"] == 2


@pytest.mark.parametrize("edges", ["linear", "quadratic"])
def test_components_in_tasks_settle_as_by_joins(spark, edges, monkeypatch):
    """Where the work is done does not matter to the result, also when some components are too large for a task."""
    rng = random.Random(11)
    buckets = cliques(rng, 5, 8, 6) | {f"r{g}.{k}": rng.sample(range(9000 + 50 * g, 9000 + 50 * g + 6 + g), 3) for g in range(8) for k in range(5 + g)}
    found = {}
    for small in (0, 20, communities.SMALL):
        monkeypatch.setattr(communities, "SMALL", small)
        found[small] = split(spark, buckets, "louvain", edges)
    assert found[0] == found[20] == found[communities.SMALL] and len(found[0]) > 10


def test_small_components_take_no_round_of_joins(spark, monkeypatch):
    monkeypatch.setattr(communities, "_level", lambda *a: pytest.fail("a round of joins"))
    buckets = {f"g{g}.{k}": [10 * g + k, 10 * g + k + 1, 10 * g + (k + 3) % 5] for g in range(40) for k in range(4)}
    assert sum(len(c) for c in split(spark, buckets)) == 40 * 5
