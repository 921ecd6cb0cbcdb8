import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinsift.llm import decontaminate, quality, toxicity
from twinsift.llm.texts import words_of


def sentence(rng, n=40, words="alpha beta gamma delta eps zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


def toxic_corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words, toxic = sentence(rng).split(), i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Moron", "scum,", "lowei" + rng.choice("abcdefg") * 3]))
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    rows += [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "moron " * 3000, "en", "s", 0), (None, "moron scum", "en", "s", 0), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", score double")
    got = toxicity.toxic_documents(docs, spark.createDataFrame(labels + [(7, None, None), (None, 1, 1)], LABELS)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in held]
    assert np.mean(right) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[-1]["score"] == by_id[-2]["score"] < 0.7 <= by_id[-3]["score"] and all(0 <= r["score"] <= 1 for r in got)
    span = by_id[6]["segments"][0]
    assert any(w in rows[6][1].split()[span["first"] : span["end"]] for w in ("Moron", "scum,")) or "lowei" in rows[6][1]
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.7}


def test_scores_of_the_fit_against_brute_force(spark):
    """Every feature above the least score has its log-odds, those of a single toxic text, too."""
    rng = random.Random(14)
    rows = [(i, sentence(rng, 20) + (f" vile{i}word Scum!" if i % 40 == 0 else ""), "en", "s", 1) for i in range(600)]
    labels = [(i, 1, int(i % 40 == 0)) for i in range(600)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, toxicity.training_sample(table, toxicity.may_learn()))
    learnt = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    counts, sizes = {}, [0, 0]
    for i in learnt:
        toxic, features = int(i % 40 == 0), set()
        for w in (w.strip("!").lower() for w in rows[i][1].split()):
            features |= {w} | {w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k}
        sizes[toxic] += len(features)
        for f in features:
            counts.setdefault(f, [0, 0])[toxic] += 1
    assert 0 < sum(i % 40 == 0 for i in learnt) < 0.05 * len(learnt)

    def brute(z):
        scores = {f: toxicity.log_odds(t, c, sizes[1], sizes[0], z, np.log, np.sqrt) for f, (c, t) in counts.items()}
        return {f: round(float(s), 9) for f, s in scores.items() if s > model.least}

    got = {f: round(float(s), 9) for f, s in zip(model.features, model.scores)}
    assert got and got in [brute(z) for z in toxicity.ZS]
    assert any(counts[f][1] == 1 for f in got)


def test_toxicity_without_labels(spark):
    rows, _ = toxic_corpus(20)
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxic_documents(docs, none).collect()} == {0.0}
    assert toxicity.toxic_documents(docs.limit(0), none).count() == 0
    assert toxicity.keep_clean(docs, none).count() == 20


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = toxic_corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxic_documents(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def brute_segments(scores):
    """All maximal segments by recursion: the best segment of a range, then the ranges beside it."""

    def best(lo, hi):
        top, at = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top + 1e-12:
                    top, at = total, (i, j + 1)
        return [] if at is None else best(lo, at[0]) + [(*at, round(top, 6))] + best(at[1], hi)

    return best(0, len(scores))


def test_maximal_segments_against_recursion():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 25)
        hits = [(i, rng.uniform(0.1, 4.0)) for i in range(n) if rng.random() < 0.4]
        scores = np.full(n, -0.5)
        for i, s in hits:
            scores[i] += s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(hits, 0.5)]
        assert got == brute_segments(scores), hits


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        text, kind = sentence(rng), i % 5
        if kind == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " ".join(w for w in text.split()[:6] for _ in range(9)), text.replace(" ", " | ")])
        rows.append((i, text))
        labels.append((i, int(kind != 0), 0))
    rows += [(1000, None), (1001, ""), (None, "x y z"), (1002, "word " * 20000)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, known).collect()}
    assert got.keys() == {r[0] for r in rows} and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 5 != 0) for i in held]) > 0.95
    assert got[1000] == got[1001] and got[1002] < 0.3
    turned = [(i, 1 - q, t) if i in set(held) else (i, q, t) for i, q, t in labels]
    assert {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, spark.createDataFrame(turned, LABELS)).collect()} == got
    assert {r["score"] for r in quality.quality_scores(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), known).count() == 0


def test_votes_are_exact_neighbours():
    """The model's vectors and votes against a dense computation, text by text."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(1, 60)) if i % 3 else sentence(rng, 9).upper() + " !!" for i in range(90)] + [None, "", "a a a"]
    labels = [i % 3 > 0 for i in range(90)] + [True, False, True]

    def counts(text):
        words, out = (text or "").split(), np.zeros(quality.COLUMNS)
        for k, w in enumerate(words):
            for column, n in quality.columns_of(w):
                out[column] += n
            out[quality.REPEAT] += k > 0 and words[k - 1] == w
        return out

    terms = quality.term_counts(words_of(pa.array(texts, pa.string())), {})
    dense = np.zeros((len(texts), quality.COLUMNS))
    dense[terms.text, terms.column] = terms.n
    assert (dense == np.stack([counts(t) for t in texts])).all()
    model = quality.fit_model([(tuple(np.flatnonzero(r).tolist()), tuple(r[r > 0].tolist()), int(y)) for r, y in zip(dense, labels)])
    shape = np.r_[0 : quality.SHAPES, quality.REPEAT]

    def vector(row):
        z = np.sqrt(row / max(1, row[shape].sum())) * model.idf @ model.basis
        return z / max(np.linalg.norm(z), 1e-12)

    got = model.score(terms)
    for i, row in enumerate(dense):
        cosine = vector(row) @ model.voters
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0.0) ** quality.SHARPNESS
        other = np.argsort(-cosine)[quality.NEIGHBOURS]
        if w.sum() < 1e-9:
            assert got[i] == model.prior
        elif cosine[near[-1]] - cosine[other] > 1e-5:  # no tie at the edge of the neighbourhood
            assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-3


def test_randomised_svd_finds_the_leading_space():
    rng = np.random.default_rng(5)
    a = (rng.standard_normal((80, 6)) * [9, 8, 7, 6, 5, 4]) @ rng.standard_normal((6, 50)) + 0.01 * rng.standard_normal((80, 50))
    v, exact = quality.randomised_svd(a, 6), np.linalg.svd(a)[2][:6].T
    assert np.linalg.norm(v @ v.T - exact @ exact.T) < 0.02


def test_all_of_a_text_without_spaces_bears_on_its_terms():
    start = "ab" * 32
    calm, wild = quality.shapes(start + "cd" * 500), quality.shapes(start + "Z9+/" * 250)
    assert calm != wild and sum(wild.values()) > 100
    assert quality.shapes("字" * 64) == {"a": 1} and quality.shapes("字" * 640) == {"a": 10}
    assert quality.shapes("a1b2c3d4e5!!") == {"a9a9a9a9": 1, "a9!": 1} != quality.shapes("a1b2c3d4e5??ZZ9")
    assert quality.shapes("Word,") == {"Aa,": 1} and quality.shapes("") == {}


def test_odd_rows_of_quality(spark):
    """Repeated labelled ids, clashing names and bytes that are no text."""
    rows = [(i, f"word{i} some text here {i}", "t") for i in range(60)] + [(1, "another text under one id", "t"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("_label", F.lit(5)).withColumn("_fold", F.lit("x"))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.expr("cast(unhex('ff41fe20e9') as string)")}))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(1, 0, 0), (1, 1, 1)], LABELS)
    assert quality.quality_scores(docs, labels).count() == toxicity.toxic_documents(docs, labels).count() == 63
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def leak_corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(16, 60))) for i in range(40)]
    docs, want = [], {}
    for i in range(400):
        words = text(rng.randrange(30, 300)).split()
        if i % 4 == 0:
            k, kind = rng.randrange(40), (i // 4) % 4
            leak = items[k][1].split()
            if kind == 1:
                leak = [w.upper() + "!!" for w in leak]
            if kind == 2:
                leak = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in leak]
            if kind == 3:
                leak = [x for w in leak for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.1 else [w])]
            at = rng.randrange(len(words))
            words[at:at] = leak
            want[i] = (k, kind)
        docs.append((i, " ".join(words)))
    return docs, items, want


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    docs, items, want = leak_corpus()
    extra = [(1000, None), (1001, ""), (1002, "?! ..."), (None, items[3][1]), (0, docs[0][1]), (1003, "filler word " * 20000 + items[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs + extra], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, items[3][1])], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in got]
    truth = {(i, k) for i, (k, _) in want.items()}
    truth |= {(i, 92) for i, (k, _) in want.items() if k == 3} | {(None, 3), (None, 92), (1003, 5)}
    assert set(pairs) <= truth
    exact = {(i, k) for i, (k, kind) in want.items() if kind < 2} | {(None, 3), (1003, 5)}
    assert exact <= set(pairs)
    changed = {(i, k) for i, (k, kind) in want.items() if kind >= 2}
    assert len(changed & set(pairs)) >= 0.95 * len(changed)
    assert pairs.count((0, want[0][0])) == 2
    kept = decontaminate.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns
    bad = {i for i, _ in pairs}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs + extra if i not in bad)
    empty = decontaminate.contaminated(df, bench.limit(0))
    assert empty.columns == ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"] and empty.count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.keep_uncontaminated(df, bench.limit(0)).count() == df.count()


def test_an_item_in_a_third_of_the_documents_is_found_in_all_of_them(spark):
    docs, items, _ = leak_corpus()
    everyday = (900, "the of and to in the and of to in of the to and in the of to")
    clean = [(i, t) for i, t in docs if i % 4]
    hot = [(i, f"{t} {items[7][1]}" if i % 3 == 0 else f"{t} {everyday[1]}" if i % 3 == 1 else t) for i, t in clean]
    df, bench = spark.createDataFrame(hot, "doc_id long, text string"), spark.createDataFrame(items + [everyday], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {(i, 7) for i, _ in hot if i % 3 == 0} <= found and {(i, 900) for i, _ in hot if i % 3 == 1} <= found
    assert {d for d, k in found if k not in (7, 900)} == set()


def test_leaks_are_found_at_every_offset_however_large_the_corpus():
    _, items, _ = leak_corpus()
    items = items + [(40 + k, " ".join(t.split()[:n])) for (k, t), n in zip(items, (8, 9, 10, 12) * 2)] + [(60, " ".join(t for _, t in items[:30]))]
    rng = random.Random(4)
    words = decontaminate.item_words([t for _, t in items])
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    for n in (10**3, 10**5, 3 * 10**8):
        b = decontaminate.Benchmark([i for i, _ in items], [np.array([vocabulary[w] for w in ws], dtype=np.int32) for ws in words], vocabulary)
        share = np.random.default_rng(3).choice([0.3, 0.05, 0.01], len(vocabulary))
        share[5] = 0
        b.weight = 1 + np.log((1 + n) / (1 + share * n))
        b.other = float(b.weight.max())
        b.basis = np.eye(len(vocabulary), dtype=np.float32)
        own, ends = np.concatenate(b.items), np.r_[0, np.cumsum([len(x) for x in b.items])]
        b.item_of, start, end = decontaminate.windows(ends)
        b.passages = decontaminate._rows(b, own, start, end, b.basis)
        b.passages /= np.linalg.norm(b.passages, axis=1, keepdims=True)
        judge = decontaminate.Judge(b)
        texts, of = [], []
        for k, x in enumerate(b.items):
            for offset in (0, 3, 7, 11, 15, 100):
                for changed in (0, 0.2, 0.38):
                    leak = x.copy()
                    leak[rng.sample(range(len(x)), int(changed * len(x)))] = decontaminate.OTHER
                    texts.append(np.r_[np.full(offset, -1), leak, np.full(200, -1)].astype(np.int32))
                    of.append((k, changed))
        found = {(t, k) for t, k, *_ in judge.found(pa.array([t.tobytes() for t in texts], pa.binary()))}
        assert {(t, k) for t, (k, changed) in enumerate(of) if not changed} <= found
        brute = {(t, k) for t, (k, _) in enumerate(of) if judge.verify(k, texts[t].tolist())}
        assert brute <= found and len(brute) > len(texts) / 2


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items, _ = leak_corpus()
    df, bench = spark.createDataFrame(docs[:80], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == whole


def test_clashing_columns_come_through(spark):
    docs, items, want = leak_corpus()
    df = spark.createDataFrame([(i, t, 777, "k", i) for i, t in docs[:40]], "doc_id long, text string, _key int, key string, of long")
    kept = decontaminate.keep_uncontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {(i, t, 777, "k", i) for i, t in docs[:40] if i not in want}


def test_the_query_against_brute_force(spark):
    """The query's pairs against every item at every place of every text, by the checks alone."""
    from twinsift.llm import queries

    small = "/root/testdata/sf0.01"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(c, "text").orderBy(c).collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op2_latent_decontamination(spark, small).collect()}
    words = decontaminate.item_words([t for _, t in items])
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    texts = decontaminate.item_words([t for _, t in docs])
    df = np.zeros(len(vocabulary))
    for ws in texts:
        df[[vocabulary[w] for w in set(ws) & vocabulary.keys()]] += 1
    b = decontaminate.Benchmark([i for i, _ in items], [np.array([vocabulary[w] for w in ws], dtype=np.int32) for ws in words], vocabulary)
    b.weight, b.passages = 1 + np.log((1 + len(docs)) / (1 + df)), np.zeros((1, 1))
    judge, brute = decontaminate.Judge(b), set()
    for (doc, _), ws in zip(docs, texts):
        ids = [vocabulary.get(w, decontaminate.OTHER) for w in ws]
        for k, item in enumerate(b.ids):
            n = len(b.items[k])
            if any(judge.verify(k, ids[max(0, s - n) : s + decontaminate.WIDTH + n]) for s in range(0, max(1, len(ids)), decontaminate.STRIDE)):
                brute.add((doc, item))
    assert len(brute) > 20 and len(brute & got.keys()) >= 0.9 * len(brute)
    assert {(d, i) for d, t in docs for i, x in items if t and x in t} <= got.keys()
    assert all(got[p]["cosine"] >= decontaminate.PARAPHRASE for p in got.keys() - brute)


def test_a_paraphrase_is_found_by_the_latent_space_where_tf_idf_misses_it(spark, monkeypatch):
    """Words that the corpus uses in the same places stand for each other; the item's answer stays."""
    rng = random.Random(21)
    monkeypatch.setattr(decontaminate, "RANK", 16)  # few directions, as real corpora have more subjects than any rank
    pairs = [[(f"t{k}a{i}", f"t{k}b{i}") for i in range(24)] for k in range(12)]
    pick = lambda k, n: [rng.choice(pair) for pair in rng.choices(pairs[k], k=n)]
    docs = [(i, " ".join(pick(i % 12, 160))) for i in range(360)]
    answer = ["the", "final", "answer", "is", "fortytwo"]
    item = " ".join([a for a, _ in pairs[0][:15]] + answer)
    said = " ".join([b if k % 3 else a for k, (a, b) in enumerate(pairs[0][:15])] + answer)
    others = [(100 + k, " ".join(w for pair in pairs[k] for w in pair)) for k in range(12)]  # through them the vocabulary has both words of a pair
    clean = " ".join(pick(5, 60))
    docs += [(1000, " ".join(pick(3, 8)) + " " + said), (1001, clean)]
    a, b = (set(x.split()) for x in (item, said))
    assert len(a & b) / len(a) < decontaminate.LCS  # so few words are shared that no copy with changed words is seen in it
    bench = spark.createDataFrame([(1, item), *others], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert (1000, 1) in found and found[1000, 1]["cosine"] >= decontaminate.PARAPHRASE and found[1000, 1]["lcs"] < decontaminate.LCS
    assert 1001 not in {d for d, i in found if i == 1}


def test_short_items_must_stand_word_after_word(spark):
    rng = random.Random(8)
    for _ in range(500):
        words, item = [rng.randrange(3) for _ in range(rng.randrange(12))], [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        assert decontaminate.holds(words, item) == any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows = [(i, filler(40) + " zebra " + filler(2) + " quartz " + filler(1) + " lantern " + filler(40)) for i in range(5)]
    rows += [(10 + i, filler(20 + 7 * i) + ' "Zebra, quartz ... lantern!" ' + filler(30)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "zebra quartz lantern")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == set(range(10, 15))


def test_subsequences_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs_length(decontaminate._places(np.array(a)), len(a), b) == table[-1, -1]


def test_sketch_spans_the_passages_leading_directions(spark):
    docs, items, _ = leak_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = decontaminate.item_words([t for _, t in items])
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    b = decontaminate.Benchmark([i for i, _ in items], [np.array([vocabulary[w] for w in ws], dtype=np.int32) for ws in words], vocabulary)
    encoded, _ = decontaminate.encode(df, b)
    freq, n = decontaminate.document_frequencies(encoded, b)
    sets = [set(ws) for ws in decontaminate.item_words([t for _, t in docs])]
    assert n == len(docs) and [int(x) for x in freq] == [sum(w in s for s in sets) for w in vocabulary]
    b.weight = np.log((1 + n) / (1 + freq))
    b.other = float(b.weight.max())
    v = decontaminate.latent_directions(encoded, b, rank=20)
    rows = []
    for r in encoded.collect():
        ids = np.frombuffer(r["words"], dtype=np.int32)
        for _, s, e, norm in decontaminate._passing(b, ids, np.array([0, len(ids)])):
            rows.append(decontaminate._rows(b, ids, s, e, np.eye(len(vocabulary), dtype=np.float32)) / norm[:, None])
    a = np.concatenate(rows)
    best = np.linalg.svd(a)[1][:20]
    assert np.linalg.norm(a @ v) ** 2 > 0.75 * (best**2).sum()
