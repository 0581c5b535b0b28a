"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document can be taken zero, one or two times; without constraints the copies
are binomial (2, 1/2), once on average. The nearest distribution in relative
entropy whose expected words of each source equal the source's target tilts the
documents exponentially: document d of source s is taken at the rate
2 / (1 + exp(-lambda_s x_d)), x_d its size over the source's mean size. The
lambdas solve a convex dual, found by Newton steps guarded by bisection; each
step is one aggregate over the sizes of all sources together.

A document's rate becomes copies by its hash u: floor(rate + u), so that the mean
is the rate. What the words of a source then lack or exceed (the rounding's
residue, small against the target) is made up by the documents whose rate + u is
nearest to the next whole number; the last of them gives or gets only the words
still missing. Hashes of id and text decide alone, so reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times; null
sources are one source, ordered last; rows that repeat a doc_id are rows of
their own, and equal rows may get different shares, the same ones in every run;
texts of any length count whole; other columns are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST_COPIES = 2
NEWTON_STEPS = 100
#: A source whose words are within this share of the target is solved.
CLOSE = 1e-9
#: Bins of a unit of rate + u, and how many make a coarse one. The bin in which a source meets its
#: target is found among coarse bins first, then in one of them; its rows alone are put in order.
BINS, COARSE = 1 << 20, 1 << 10


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources(source) with their rank by code point, nulls last, without a task that holds them all."""
    ordered = settle(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "source", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("inner")
        )
    )
    count = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(before.select("part", "before"), "part").select("source", (F.col("before") + F.col("inner")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, weight, source_size, target) of sizes(source, size, n): weighted shares, capped and reshared."""
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    rows = numbered(total.select("source")).withColumn("weight", weight)
    rows = settle(rows.alias("r").join(total.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "weight", "source_size"))
    share, full = 0.0, F.col("source_size") * most
    while True:
        stopped = F.col("weight") * F.lit(share) >= full
        got = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(stopped, full)), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
        ).first()
        if not got[2]:
            break
        more = (got[0] * percent / 100 - got[1]) / got[2]
        if more <= share:
            break
        share = more
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), full.cast("double")))


def solve_dual(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(source, mean_size, lam): the dual variable of each source with words; null where all slots are taken."""
    mean = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    base = targets.alias("t").join(mean.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")))
    state = settle(
        base.select("t.source", "mean_size", "target", (F.col("target") >= F.col("source_size") * most).alias("full"), F.lit(0.0).alias("lam"),
                    F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("gap"))
    )
    rate = F.lit(float(most)) / (1 + F.exp(-F.greatest(F.least(F.col("lam") * F.col("x"), F.lit(500.0)), F.lit(-500.0))))
    rows = sizes.where("size > 0").alias("s")
    for _ in range(NEWTON_STEPS):
        open_ = state.where((F.abs("gap") > CLOSE) & ~F.col("full"))
        if open_.isEmpty():
            break
        at = rows.join(open_.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
            "p.*", "size", "n", (F.col("size") / F.col("mean_size")).alias("x")
        )
        at = at.withColumn("rate", rate)
        words = F.col("rate") * F.col("size") * F.col("n")
        slope = words * (1 - F.col("rate") / most) * F.col("x")
        step = at.groupBy("source", "mean_size", "target", "full", "lam", "lo", "hi").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        over = F.col("words") - F.col("target")
        step = step.withColumn("gap", over / F.col("target"))
        step = step.withColumn("hi", F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(over <= 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - over / F.greatest(F.col("slope"), F.lit(1e-300))
        # Where Newton leaves the bracket: bisect it, on a scale of magnitudes while it's wide.
        wide = F.signum(F.col("lo") + F.col("hi")) * F.sqrt(F.abs(F.col("lo") * F.col("hi")))
        middle = F.when((F.col("lo") * F.col("hi") > 0) & (F.col("hi") - F.col("lo") > 1), wide).otherwise((F.col("lo") + F.col("hi")) / 2)
        middle = F.when(F.col("hi") == 1e6, F.abs(F.col("lam")) * 4 + 1).when(F.col("lo") == -1e6, -F.abs(F.col("lam")) * 4 - 1).otherwise(middle)
        moved = F.when(F.abs("gap") <= CLOSE, F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        step = step.select("source", "mean_size", "target", "full", moved.alias("lam"), "lo", "hi", "gap")
        state = settle(step.unionAll(state.where((F.abs("gap") <= CLOSE) | F.col("full"))))
    else:
        raise RuntimeError(f"the dual is not solved after {NEWTON_STEPS} steps")
    return state.select("source", "mean_size", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def _reached(bins: DataFrame) -> DataFrame:
    """Of bins(own, goal, before, bin, words) the one in which each source's words reach the goal; before counts all words ahead of it."""
    upto = Window.partitionBy("own").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    return bins.where("before < goal and before + words >= goal")


def mixed(
    documents: DataFrame, carried: list[str], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES
) -> DataFrame:
    """(doc, size, source_size, target, rate, taken, copies) of every row of documents(doc_id, text, source); doc holds the carried columns."""
    seed = F.xxhash64("doc_id", "text", F.lit("mix"))
    docs = settle(
        documents.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
            "source",
            n_words(F.col("text")).alias("size"),
            seed.alias("seed"),
        )
    )
    sizes = settle(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(sizes, weights, percent, most)
    dual = solve_dual(sizes, targets, most)
    facts = settle(
        targets.alias("t").join(dual.alias("d"), F.col("t.source").eqNullSafe(F.col("d.source")), "left")
        .select(F.col("t.source").alias("own"), "source_size", "target", F.round("target").cast("long").alias("goal"), "mean_size", "lam")
    )
    rows = docs.join(facts, F.col("source").eqNullSafe(F.col("own")))
    tilt = F.greatest(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.lit(500.0)), F.lit(-500.0))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(most)).otherwise(F.lit(float(most)) / (1 + F.exp(-tilt)))
    rows = rows.withColumn("rate", rate)
    uniform = (F.pmod("seed", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Copy j of a document is taken where its gap is at most 0; gaps of a document's copies are 1 apart.
    rows = rows.withColumn("gap", 1 - F.col("rate") - uniform).withColumn("bin", F.floor(F.col("gap") * BINS).cast("int"))

    steps = F.array(*[F.col("bin") + BINS * j for j in range(most)])
    slots = rows.where("size > 0").select("own", "goal", "size", F.explode(steps).alias("bin"))
    slots = slots.withColumn("coarse", F.floor(F.col("bin") / COARSE).cast("int"))
    first = _reached(slots.withColumn("before", F.lit(0)).groupBy("own", "goal", "before", F.col("coarse").alias("bin")).agg(F.sum("size").alias("words")))
    first = first.select(F.col("own").alias("at"), F.col("bin").alias("edge"), "before")
    inside = slots.join(first, F.col("own").eqNullSafe(F.col("at")) & (F.col("coarse") == F.col("edge")))
    edge = settle(_reached(inside.groupBy("own", "goal", "before", "bin").agg(F.sum("size").alias("words"))))
    edge = edge.select(F.col("own").alias("at"), F.col("bin").alias("edge"), "before")
    placed = rows.join(edge, F.col("own").eqNullSafe(F.col("at")), "left")
    whole = sum((F.coalesce(F.col("bin") + BINS * j < F.col("edge"), F.lit(False)).cast("long") for j in range(most)), F.lit(0))
    here = (F.col("size") > 0) & (F.pmod(F.col("bin"), F.lit(BINS)) == F.pmod(F.col("edge"), F.lit(BINS)))
    here &= (F.col("bin") <= F.col("edge")) & (F.col("bin") + BINS * (most - 1) >= F.col("edge"))
    placed = placed.withColumn("whole", whole * F.col("size")).withColumn("here", F.coalesce(here, F.lit(False)))
    inner = Window.partitionBy("own").orderBy(F.col("gap") * BINS - F.col("bin"), "seed", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto_here = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - upto_here))
    last = placed.where("here").withColumn("taken", (F.col("whole") + part).cast("long"))
    out = placed.where("not here").withColumn("taken", F.col("whole")).unionByName(last)
    copies = F.ceil(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int")
    return out.select("doc", "size", "source_size", "target", F.round("rate", 6).alias("rate"), "taken", copies.alias("copies"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rate, copies) of every row of documents(doc_id, text, source)."""
    out = mixed(documents, ["doc_id", "source"], weights, percent, most)
    return out.select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken", "rate", "copies")
