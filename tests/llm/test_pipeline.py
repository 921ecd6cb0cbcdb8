import corpus_pipeline
from test_duplicates import brute_fingerprint, closure
from test_mixing_sharding import brute_sample, brute_targets, size_of

from twinsift.llm import decontaminate, mixing, queries, toxicity

SMALL = "/root/testdata/sf0.001"


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the stage before it kept, each held against a plain computation over its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")

    # Toxicity: the model's own words, summed up by hand over every run of words of every text.
    before, after = (x.collect() for x in kept["toxicity"])
    model = toxicity.fit(kept["toxicity"][0], toxicity.training_sample(labels, toxicity.may_learn()))
    score = dict(zip(model.features, model.scores))

    def of_word(word):
        w = word.lower()
        while w and not (w[0].isalnum() or w[0] == "_"):
            w = w[1:]
        while w and not (w[-1].isalnum() or w[-1] == "_"):
            w = w[:-1]
        best = max([score.get(w, 0.0), *(score.get(w[:k] + "*", 0.0) for k in toxicity.PREFIXES if len(w) > k)]) if w else 0.0
        return best if best > model.least else 0.0

    def best_runs(s):  # the best run of a range, then the ranges beside it
        low, run, top, at = 0.0, 0.0, 0.0, None
        first = 0
        for j, x in enumerate(s):
            run += x
            if run - low > top + 1e-12:
                top, at = run - low, (first, j + 1)
            if run < low:
                low, first = run, j + 1
        return [] if at is None else [*best_runs(s[: at[0]]), (*at, top), *best_runs(s[at[1] :])]

    clean = []
    for r in before:
        words = (r["text"] or "").split()
        segments = best_runs([of_word(w) - toxicity.DRIFT for w in words]) if any(of_word(w) for w in words) else []
        if model.score(model.evidence(len(words), segments)) < toxicity.CUT:
            clean.append(r)
    assert ids(after) == ids(clean) and len(after) < len(before)

    before, after = (x.collect() for x in kept["simhash_near_dedup"])
    fps = [brute_fingerprint(r["text"]) for r in before]
    roots = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    first = {}
    for r, root in zip(before, roots):
        first[root] = min(first.get(root, r["doc_id"]), r["doc_id"])
    assert ids(after) == sorted(first.values()) and len(after) < len(before)

    before, after = (x.collect() for x in kept["benchmark_decontamination"])
    leaked = {r["doc_id"] for r in before if any(b["text"] in (r["text"] or "") for b in bench.collect())}
    assert ids(after) == sorted(r["doc_id"] for r in before if r["doc_id"] not in leaked)
    assert leaked <= {r["doc_id"] for r in decontaminate.contaminated(kept["benchmark_decontamination"][0], bench).collect()}

    before, after = (x.collect() for x in kept["mixing"])
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size_of(r["text"])
    want, decided, source = brute_targets(sizes), mixing.mix_sources(kept["mixing"][0]).collect(), {r["doc_id"]: r["source"] for r in before}
    copies = {}
    for s, target in want.items():
        whole = int(target / sizes[s] + 1e-12)
        own = [r for r in decided if source[r["doc_id"]] == s]
        chosen = brute_sample(own, target - whole * sizes[s])
        copies |= {r["doc_id"]: whole + ((r["_key"], r["_copy"]) in chosen) for r in own}
    assert ids(after) == sorted(i for i, n in copies.items() for _ in range(n))

    before, after = (x.collect() for x in kept["sharding"])
    assert ids(before) == ids(after)
    total, of_text = [0] * 16, {}
    for r in after:
        total[r["shard"]] += r["size"]
        of_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    largest = max(sum(r["size"] for r in after if (r["size"], r["text_crc32"]) == k) for k in of_text)
    assert all(len(s) == 1 for s in of_text.values()) and max(total) <= sum(total) / 16 + largest
    for s in range(16):
        slots = sorted(r["slot"] for r in after if r["shard"] == s)
        assert slots == list(range(len(slots)))

    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r) for r in kept["sharding"][1].select(whole[0].__fields__).collect())


def test_odd_rows_pass_every_stage(spark):
    """Null, empty, repeated and very long texts, null ids, and columns with the names of helpers."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = docs.selectExpr(*docs.columns, "'k' as _key", "doc_id as key", "7 as of", "text as row", "1 as _copy", "2 as copies", "3 as _label")
    odd = docs.limit(1)
    rows = [odd.selectExpr(*[f"{e} as {c}" if (e := changed.get(c)) else c for c in docs.columns]) for changed in (
        {"doc_id": "cast(null as bigint)"}, {"text": "cast(null as string)", "doc_id": "901L"}, {"text": "''", "doc_id": "902L"}, {"text": "repeat('word', 300000)", "doc_id": "903L"},
        {"source": "cast(null as string)", "lang": "cast(null as string)", "doc_id": "904L", "text": "'own words of a text'"}, {"doc_id": "905L", "text": "'twice the same'"}, {"doc_id": "905L", "text": "'twice the same'"})]
    for r in rows:
        docs = docs.unionByName(r)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        none = stage(spark, docs.limit(0), SMALL)
        assert none.count() == 0
        if name == "sharding":
            assert out.count() == n
            continue
        assert out.columns == docs.columns == none.columns
        seen = {tuple(r) for r in docs.collect()}
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= seen and (name == "mixing" or len(got) <= n)
        if name == "simhash_near_dedup":
            assert sum(r[0] == 905 for r in got) == 1 and any(r[0] is None for r in got)
        if name in ("toxicity", "benchmark_decontamination"):
            assert sum(r[0] == 905 for r in got) == 2 and {901, 902, 903, 904} <= {r[0] for r in got}


def test_every_query_returns_its_rows_and_columns(spark):
    count = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").count()
    documents = count("documents")
    want = {
        "op1": ({"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, 1 + spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()),
        "op3": ({"page_id", "host", "path", "rule", "verdict"}, count("pages")), "op4": ({"doc_id", "held_out", "score", "predicted"}, documents),
        "op5": ({"doc_id", "n_words", "n_tokens"}, documents), "op6": ({"vec_id", "n_links", "component_id", "kept"}, count("embeddings")),
        "op7": ({"doc_id", "fingerprint", "component_id"}, documents), "op8": ({"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, documents),
        "op9": ({"doc_id", "size", "source_size", "target", "taken"}, documents), "op10": ({"doc_id", "held_out", "score", "predicted"}, documents),
    }
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] in want:
            columns, rows = want[name.split("_")[0]]
            found = query(spark, SMALL)
            assert columns <= set(found.columns) and found.count() == rows, name
