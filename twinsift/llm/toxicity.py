"""Toxicity by maximum-scoring segments of token log-odds.

Fitting counts, over a bounded sample of labelled documents, in how many toxic and clean documents each word and
each of its prefixes occurs, against the number of features of either kind.  A feature's score is its log-odds
under a Dirichlet prior centred on the corpus, less some standard deviations; a word has the highest score of
its features, and every feature that can score is kept.  Every token also
pays ``DRIFT``, so clean text drifts down, and one linear scan finds all maximal scoring segments of a text.

Segment scores of clean documents have an exponential tail, hence an extreme-value law for the best of a text's n
tokens: a segment's evidence is minus the log of the number of segments of at least its score that clean
text of that length has by chance.  A document adds the evidence of its significant segments; its score
is a logistic in that sum, placed by held-out (cross-fitted) evidence.

Words are split, told apart and looked up by Arrow kernels; only the words that score are seen one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.llm.texts import Words, by_bytes, words_of

SAMPLE = 20_000  # labelled documents that fitting reads at most, taken by hash
PREFIXES = (3, 4, 5, 6)
PRIOR, DRIFT = 2.0, 0.5
#: Standard deviations taken off a score, and scores below which a token does not count: held-out folds choose.
ZS, LEAST = (1.0, 1.64, 2.33), (1.0, 1.5, 2.0, 2.5, 3.0)
TAIL = 1.0  # segment score from which the tail is fitted
CUT, SLOPE = 0.7, 0.5
_EDGE = r"^[^\pL\pN_]+|[^\pL\pN_]+$"
FOLDS = ((0, 1), (0,), (1,))  # what a model learns from: all, or one fold, to be judged by the other


def features_of(words: pa.Array) -> list[pa.Array]:
    """Of each word, freed of case and outer punctuation: itself, and its prefixes (marked by a trailing ``*``), null where it has none."""
    w = pc.replace_substring_regex(pc.utf8_lower(words), pattern=_EDGE, replacement="")
    none = pa.scalar(None, pa.string())
    long = lambda k: pc.greater(pc.utf8_length(w), k)
    prefix = lambda k: pc.binary_join_element_wise(pc.utf8_slice_codeunits(w, 0, k), "*", "")
    return [pc.if_else(pc.equal(w, ""), none, w), *(pc.if_else(long(k), prefix(k), none) for k in PREFIXES)]


def log_odds(toxic, clean, n_toxic: float, n_clean: float, z: float, log, sqrt):
    """Of a feature in so many toxic and clean documents, less z standard deviations; on arrays or on columns."""
    base = n_toxic / (n_toxic + n_clean)
    t, c = toxic + PRIOR * base, clean + PRIOR * (1 - base)
    return log(t / c) - math.log(base / (1 - base)) - z * sqrt(1 / t + 1 / c)


@dataclass
class Model:
    """``features`` and their ``scores``, log-odds; ``rate`` and ``slope``: tail of clean segments; ``middle``:
    evidence at CUT; ``quality``: F1 there on held-out folds."""

    features: list[str] = field(default_factory=list)
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1e-4
    slope: float = 1.0
    middle: float = math.inf
    quality: float = 0.0
    least: float = min(LEAST)

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Number of words and the maximal segments (first word, end, score) of each text."""
        words = words_of(texts)
        found = hits(words, word_scores(words.distinct, self.features, self.scores[:, None])[:, 0], self.least)
        return ((n, maximal_segments(h)) for n, h in zip(np.diff(words.ends).tolist(), found))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        expected = math.log(max(n, 1) * self.rate)
        return sum(max(0.0, self.slope * (s - TAIL) - expected) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        if self.middle == math.inf:
            return 0.0
        x = SLOPE * (evidence - self.middle) + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def word_scores(words: pa.Array, features: list[str], scores: np.ndarray) -> np.ndarray:
    """For each word and column of ``scores`` (by feature) the highest score of the word's features, at least 0."""
    table = np.concatenate([scores, np.zeros((1, scores.shape[1]))])
    known = pa.array(features, pa.string())
    best = np.zeros((len(words), scores.shape[1]))
    for names in features_of(words):
        at = pc.fill_null(pc.index_in(names, value_set=known, skip_nulls=True), len(features)).to_numpy(zero_copy_only=False)
        np.maximum(best, table[at], out=best)
    return best


def hits(words: Words, scores: np.ndarray, least: float) -> Iterator[list[tuple[int, float]]]:
    """Of each text the words (place and score) above ``least``."""
    of_word = scores[words.codes] if len(words.codes) else np.zeros(0)
    at = np.flatnonzero(of_word > least)
    ends = np.searchsorted(at, words.ends)
    for first, last, start in zip(ends[:-1].tolist(), ends[1:].tolist(), words.ends[:-1].tolist()):
        yield list(zip((at[first:last] - start).tolist(), of_word[at[first:last]].tolist())) if last > first else []


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text whose tokens cost ``drift`` each, from its positive tokens in order.

    A segment is closed under: no prefix or suffix has a negative sum, and it cannot grow.  Each hit is
    merged with open segments before it as long as that raises both their sums: linear time in the hits.
    """
    # Open segments: first word, end, sum before it, sum up to its end.
    open_: list[tuple[int, int, float, float]] = []
    total = 0.0
    last = 0
    for i, s in hits:
        before = total - drift * (i - last)
        total, last = before + s - drift, i + 1
        if s <= drift:
            continue
        first, end, lo, hi = i, i + 1, before, total
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= lo:
                j -= 1
            if j < 0 or open_[j][3] >= hi:
                break
            first, lo = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((first, end, lo, hi))
    return [(a, b, hi - lo) for a, b, lo, hi in open_]


def training_sample(labels: DataFrame, wanted: Column, label: str = "toxic", limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` labelled ids that may be learnt from, by hash; conflicting labels of an id count as 1."""
    rows = labels.where(wanted & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``text, _label, _fold``: one text of each id of ``sample`` (doc_id, _label), in a stage table.

    Of several texts under one id the one with the smallest hash: the ids bound the rows, whatever is repeated.
    """
    folded = sample.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)).cast("int"))
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(folded), "doc_id")
    one = rows.groupBy("doc_id", "_label", "_fold").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    return written(one.select("text", "_label", "_fold"))[0]


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Learn from the labelled documents of ``sample`` (doc_id, _label), a table of a documented size."""
    rows = labelled_texts(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 0):
                words = words_of(batch.column(0))
                cell = 2 * batch.column(2).to_numpy() + (batch.column(1).to_numpy() > 0)
                # Each feature of a text counts once; the whole of features stands under the empty name.
                names = pc.dictionary_encode(pa.concat_arrays(features_of(words.distinct)))
                code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).reshape(-1, len(words.distinct)).T.astype(np.int64)
                size = len(names.dictionary) + 1
                pairs = np.unique(words.text().astype(np.int64) * max(1, len(words.distinct)) + words.codes)
                text, word = np.divmod(pairs, max(1, len(words.distinct)))
                keys = (text[:, None] * size + code[word])[code[word] >= 0]
                text, feature = np.divmod(np.unique(keys), size)
                counts = np.bincount(cell[text] * size + feature, minlength=4 * size).reshape(4, size)
                counts[:, -1] = np.bincount(cell[text], minlength=4)
                used = np.flatnonzero(counts.any(axis=0))
                named = pa.concat_arrays([names.dictionary.cast(pa.string()), pa.array([""])]).take(pa.array(used))
                yield pa.record_batch([named, *(pa.array(counts[k, used]) for k in range(4))], ["feature", "n00", "n01", "n10", "n11"])

    counted = rows.mapInArrow(count, "feature string, n00 long, n01 long, n10 long, n11 long")
    sums = cut(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")]))
    total = sums.where("feature = ''").first()
    if total is None:
        return Model()
    sizes = {folds: [sum(total[f"n{f}{y}"] for f in folds) for y in (1, 0)] for folds in FOLDS}
    if not all(sizes[FOLDS[0]]):
        return Model()
    # All features that can score, whatever they were learnt from; their number is bounded by the sample's words.
    of = lambda folds, y: sum(F.col(f"n{f}{y}") for f in folds)
    chances = [log_odds(of(folds, 1), of(folds, 0), *n, min(ZS), F.log, F.sqrt) > min(LEAST) - 1e-9 for folds, n in sizes.items() if all(n)]
    can_score = chances[0]
    for c in chances[1:]:
        can_score = can_score | c
    table = sums.where("feature <> ''").where(can_score).orderBy("feature").toPandas()
    features = table.feature.tolist()

    def scores(folds: tuple[int, ...], z: float) -> np.ndarray:
        if not all(sizes[folds]):
            return np.zeros(len(features))
        toxic, clean = (sum(table[f"n{f}{y}"].to_numpy(dtype=float) for f in folds) for y in (1, 0))
        low = log_odds(toxic, clean, *sizes[folds], z, np.log, np.sqrt)
        return np.where(low > min(LEAST), low, 0.0)

    # A fold is judged by what the other has taught: column 3 * fold + number of z.
    shared = rows.sparkSession.sparkContext.broadcast((features, np.stack([scores((1 - f,), z) for f in (0, 1) for z in ZS], axis=1)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for whole in batches:
            for batch in by_bytes(whole, 0):
                words, fold = words_of(batch.column(0)), batch.column(2).to_numpy()
                of_word = word_scores(words.distinct, names, table)
                found: list[list[list[float]]] = [[] for _ in fold]
                for k in range(len(ZS)):
                    for least in LEAST:
                        for f in (0, 1):
                            for t, h in enumerate(hits(words, of_word[:, 3 * f + k], least)):
                                if fold[t] == f:
                                    found[t].append([s for _, _, s in maximal_segments(h)])
                kind = pa.list_(pa.list_(pa.float64()))
                yield pa.record_batch([pa.array((batch.column(1).to_numpy() > 0).astype(np.int32)), pa.array(np.diff(words.ends)), pa.array(found, kind)], ["label", "words", "scores"])

    held = rows.mapInArrow(judge, "label int, words long, scores array<array<double>>").toPandas()
    labels, words = held["label"].to_numpy(), held["words"].to_numpy()
    options = [(z, least) for z in ZS for least in LEAST]
    fitted = [calibrate(Model(least=least), labels, words, [s[k] for s in held["scores"]]) for k, (_, least) in enumerate(options)]
    best = max(range(len(options)), key=lambda k: fitted[k].quality)
    model, low = fitted[best], scores((0, 1), options[best][0])
    kept = np.flatnonzero(low > model.least)
    model.features, model.scores = [features[i] for i in kept], low[kept]
    return model


def calibrate(model: Model, labels: np.ndarray, words: np.ndarray, scores: list) -> Model:
    """Fit the tail of clean segments, then place the logistic where it separates the held-out documents best."""
    clean = [s for y, ss in zip(labels, scores) if not y for s in ss if s > TAIL]
    length = max(1, int(words[labels == 0].sum()))
    model.rate = (len(clean) + 0.5) / length
    model.slope = (len(clean) + 1) / (sum(clean) - TAIL * len(clean) + 1)
    found = np.array([model.evidence(int(n), [(0, 0, s) for s in ss]) for n, ss in zip(words, scores)])
    if not (labels == 1).any() or not (labels == 0).any():
        return model
    values = np.unique(found)
    middles = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values + 1e-9
    toxic, rest = np.sort(found[labels == 1]), np.sort(found[labels == 0])
    hit = len(toxic) - np.searchsorted(toxic, middles)
    false = len(rest) - np.searchsorted(rest, middles)
    f1 = 2 * hit / np.maximum(1, hit + false + len(toxic))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    model.middle, model.quality = float(middles[best[len(best) // 2]]), float(f1.max())
    return model


SCORED = "doc_id long, score double, evidence double, n_words long, segments array<struct<first:int,end:int,score:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, evidence, n_words, segments`` of every whole text.

    ``segments`` are the maximal segments (word positions) that clean text of that length has less than once by
    chance.  Null and empty texts have no evidence and the lowest score; null ids and repeated rows are kept; texts
    of any length are scanned whole; an empty table gives an empty result; further columns are ignored.
    Without labels of both kinds every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for whole in batches:
            for batch in by_bytes(whole, 1):
                rows = []
                for n, found in own.segments(batch.column(1)):
                    x = own.evidence(n, found)
                    sure = [{"first": a, "end": b, "score": s} for a, b, s in found if own.evidence(n, [(a, b, s)]) > 0]
                    rows.append((own.score(x), x, n, sure))
                cols = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.record_batch(
                    [batch.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], kind)],
                    ["doc_id", "score", "evidence", "n_words", "segments"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def may_learn() -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text, modulo 3, is not 1."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 != 1


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that may be learnt from and score all of ``docs``."""
    return score_documents(docs, fit(docs, training_sample(labels, may_learn())))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the toxic ones, columns as they were.  Scores are computed in place, row by row.

    Null and empty texts stay, as do rows with null ids; repeated rows are judged one by one, alike; an empty table
    gives an empty result; further columns are carried along whatever their names.
    """
    model = fit(docs, training_sample(labels, may_learn()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in by_bytes(whole, at):
                yield batch.filter(pa.array([own.score(own.evidence(*found)) < cut for found in own.segments(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
