"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size takes floor(r) whole copies of every document; the rest of the target, its
goal, is filled by a sample in which each document has its own inclusion probability: proportional to a preference (by
default the square root of its size), with 1 for those whose share would exceed it, and such that the words expected are
the goal.  A document larger than the goal could only miss it and has none.  Each document draws a repeatable
uniform number U and is ranked by the odds of U over its inclusion odds; documents of probability 1 come first.  The
lowest ranks are taken until the words wanted are reached.

The cut in the ranking is found without sorting a source in one task.  Ranks are mapped to (0, 1) and
summed per (source, bin); a window over a source's bins (a fixed number) finds the bin in which the target falls,
that bin is split again, and only the last sliver is ordered document by document.  What a cut leaves over is
offered, in the same order, to the documents not taken that fit, in a fixed number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import cut
from twinsift.llm.texts import packed, row_key, uniform, word_count
from twinsift.operators.numbering import order_numbers

BINS = 1024
STEPS = 8  # bins of preference in an octave, from which a source's certain documents are told
ROUNDS = 3  # the first cut, and two offers of what is left
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
BROADCAST_SOURCES = 10_000  # above it the tables with a row per source are joined by shuffle
MOST = 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``target``.

    Sources in code-point order, null last, have the weights in turn and share ``share`` of all sizes; a target
    stops at ``most`` times its source and the excess is shared again by weight, until none is above.
    One row per source throughout.
    """
    turn = F.pmod(F.col("_turn"), F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    turns = order_numbers(sizes.select("source"), "source", "_turn")
    rows = sizes.alias("s").join(turns.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "_turn")
    rows = cut(rows.withColumn("_w", w).withColumn("_top", F.col("source_size") * most).drop("_turn"))
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    # The level (words per unit of weight) rises until the capped targets add up to the budget.
    level, full = 0.0, None
    while True:
        capped = F.lit(False) if full is None else F.col("_w") * full >= F.col("_top")
        r = rows.agg(F.sum(F.when(capped, F.col("_top")).otherwise(0.0)).alias("held"), F.sum(F.when(capped, 0.0).otherwise(F.col("_w"))).alias("open")).first()
        level = (budget - r["held"]) / r["open"] if r["open"] else float("inf")
        if full is not None and level <= full * (1 + 1e-12) or level == float("inf"):
            break
        full = level
    target = F.col("_top").cast("double") if level == float("inf") else F.least(F.col("_top").cast("double"), F.col("_w") * level)
    return rows.select("source", "source_size", target.alias("target"))


def inclusion_levels(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``_s, _theta``: a document with preference p is taken with probability ``min(1, theta * p)``.

    From sums of words per (source, bin of preferences): documents of the bins above the chosen one are taken for
    certain, and theta gives those below what they leave of the goal.
    """
    step = F.floor(F.log2("_pref") * STEPS).alias("_bin")
    bins = rows.select("_s", step, "size", (F.col("size") * F.col("_pref")).alias("_share")).groupBy("_s", "_bin").agg(F.sum("size").alias("_b"), F.sum("_share").alias("_share"))
    down = Window.partitionBy("_s").orderBy(F.col("_bin").desc())
    above = F.coalesce(F.sum("_b").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_share").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = bins.select("_s", "_bin", above.alias("_above"), rest.alias("_rest")).join(goals, "_s")
    levels = levels.withColumn("_theta", F.greatest(F.col("_goal") - F.col("_above"), F.lit(0.0)) / F.col("_rest"))
    holds = F.col("_theta") * F.pow(F.lit(2.0), (F.col("_bin") + 1) / STEPS) <= 1
    return levels.groupBy("_s").agg(F.coalesce(F.max_by(F.when(holds, F.col("_theta")), F.when(holds, F.col("_bin"))), F.min_by("_theta", "_bin")).alias("_theta"))


def _bins() -> tuple[Column, Column]:
    first = F.floor(F.col("_rank") * BINS)
    return first, F.floor((F.col("_rank") * BINS - first) * BINS)


def _cuts(rows: DataFrame, want: DataFrame, small) -> DataFrame:
    """Where each source's ranking is cut: ``_s, _at1, _at2`` (bins) and ``_last`` (the last document taken).

    Documents up to the cut have at most ``_want`` words; a source that is absent fits whole.
    """
    before = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def crossing(binned: DataFrame, goals: DataFrame) -> DataFrame:
        sums = binned.groupBy("_s", "_bin").agg(F.sum("size").alias("_b"))
        sums = sums.withColumn("_before", F.coalesce(F.sum("_b").over(before), F.lit(0))).join(small(goals), "_s")
        over = sums.where(F.col("_before") + F.col("_b") > F.col("_want"))
        first = over.groupBy("_s").agg(F.min(F.struct("_bin", "_before", "_want")).alias("c"))
        return cut(first.select("_s", F.col("c._bin").alias("_at"), (F.col("c._want") - F.col("c._before")).alias("_want")))

    bin1, bin2 = _bins()
    at1 = crossing(rows.select("_s", "size", bin1.alias("_bin")), want)
    sliver = rows.join(small(at1.select("_s", "_at")), "_s").where(bin1 == F.col("_at")).drop("_at")
    at2 = crossing(sliver.select("_s", "size", bin2.alias("_bin")), at1.select("_s", "_want"))
    line = Window.partitionBy("_s").orderBy("_rank", "_key", "_copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sliver.join(small(at2), "_s").where(bin2 == F.col("_at")).withColumn("_sum", F.sum("size").over(line)).where("_sum <= _want")
    last = fits.groupBy("_s").agg(F.max(F.struct("_rank", "_key", "_copy")).alias("_last"))
    ends = at1.select("_s", F.col("_at").alias("_at1")).join(small(at2.select("_s", F.col("_at").alias("_at2"))), "_s")
    return ends.join(small(last), "_s", "left")


def _inside() -> Column:
    """Whether a document's rank lies before its source's cut; a source without a cut is taken whole."""
    bin1, bin2 = _bins()
    at_last = F.coalesce(F.struct("_rank", "_key", "_copy") <= F.col("_last"), F.lit(False))
    inside = (bin1 < F.col("_at1")) | ((bin1 == F.col("_at1")) & ((bin2 < F.col("_at2")) | ((bin2 == F.col("_at2")) & at_last)))
    return F.col("_at1").isNull() | inside


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    preference: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, _key, size, source_size, target, inclusion, copies, taken`` for every row of ``docs``.

    ``preference`` (positive; by default the square root of the size) is what inclusion probabilities are proportional
    to; ``inclusion`` is the chance of a further copy beside the whole ones.  A null text has size 0 and
    takes 0 words, as an empty one does; null sources form one source, sorted last; rows that are equal in all columns
    are ranked one by one, by their number among the repeats; an empty table gives an empty result; further columns
    tell rows apart and have no other effect.
    """
    size = word_count()
    pref = (preference if preference is not None else F.sqrt(size.cast("double"))).cast("double")
    narrow = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), row_key(docs).alias("_key"), pref.alias("_pref"))
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n"))
    narrow = cut(counted.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_n"))
    totals = source_targets(narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    s = F.xxhash64("source", F.col("source").isNull())
    goal = F.when(ratio - whole > 1e-9, F.col("target") - whole * F.col("source_size")).otherwise(0.0)
    totals = cut(totals.select(s.alias("_s"), "source_size", "target", whole.alias("_whole"), goal.alias("_goal")))
    few = totals.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    rows = cut(narrow.withColumn("_s", s).drop("source").join(small(totals), "_s"))
    fit = (F.col("size") > 0) & (F.col("_pref") > 0) & (F.col("size") <= F.col("_goal"))
    goals = totals.where("_goal > 0").select("_s", "_goal")
    levels = cut(inclusion_levels(rows.where(fit), goals))
    u = uniform("_key", "_copy", seed=seed)
    chance = F.least(F.lit(1.0), F.col("_theta") * F.col("_pref"))
    q = u / (1 - u) * (1 - F.col("inclusion")) / F.col("inclusion")
    rows = rows.join(small(levels), "_s", "left").withColumn("inclusion", F.when(fit, F.coalesce(chance, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("_rank", F.when(F.col("inclusion") > 0, q / (1 + q)).otherwise(1 - 1e-12))
    rows = cut(rows.withColumn("_chosen", F.lit(False)).drop("_theta", "_pref"))

    partial = goals
    want = partial.withColumnRenamed("_goal", "_want")
    for _ in range(ROUNDS):
        able = rows.where("not _chosen and inclusion > 0").join(small(want), "_s").where("size <= _want").drop("_want")
        cuts = _cuts(able.select("_s", "size", "_rank", "_key", "_copy"), want, small)
        fits = rows.join(small(want), "_s", "left").join(small(cuts), "_s", "left")
        newly = F.coalesce((F.col("inclusion") > 0) & (F.col("size") <= F.col("_want")) & _inside(), F.lit(False))
        rows = cut(fits.withColumn("_chosen", F.col("_chosen") | newly).select(rows.columns))
        got = rows.where("_chosen").groupBy("_s").agg(F.sum("size").alias("_got"))
        left = partial.join(small(got), "_s", "left").select("_s", (F.col("_goal") - F.coalesce("_got", F.lit(0))).alias("_want"))
        want = cut(left.where("_want > 0"))
    copies = (F.col("_whole") + F.col("_chosen").cast("int")).cast("int")
    out = rows.select("doc_id", "_key", "_copy", "size", "source_size", "target", "inclusion", "_rank", copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` decided for each of them, columns as they were, whatever their names."""
    per_key = mixed.groupBy(F.col("doc_id").alias("id"), F.col("_key").alias("of")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    keyed = packed(docs, key=row_key(docs))
    found = keyed.join(per_key, (F.col("key") == F.col("of")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    # Rows of one key are equal in all columns: any of them stands for all.
    alike = found.where("n > 1").groupBy("of", "id").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    rows = found.where("n = 1").select("row", "copies").unionByName(alike.select("row", "copies"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("again")).select("row.*")
