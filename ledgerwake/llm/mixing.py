"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document i of source s gets a rate r_i between 0 and ``most``. Of all rates that meet the token constraints,
sum over s of size_i * r_i = target_s, those are taken that stay closest to 1 in relative entropy: they minimise the
sum of r_i * ln r_i - r_i + 1. The dual is convex, one variable lambda_s for each constraint, and its solution tilts
documents exponentially by what they add to the constraint: r_i = min(most, exp(lambda_s * size_i)).

lambda_s is found by Newton steps on the sums of size * r and size^2 * r that one distributed aggregation a step gives,
over the numbers of documents of each source and size; a step that leaves the bracket around the root is replaced
by its middle. The steps start from the root for sizes parted into ``BINS`` bins an octave, and end when each source's
words are within ``CLOSE`` of its target.

Rates become copies: every document gets floor(r) whole copies. The words that are then still missing come from one
more copy of documents in the order of u_i - (r_i - floor(r_i)), u_i being a hash of the document in 0 to 1; so a
document gets it with a probability of about what floor() took off, no document gets more than ``most`` copies,
and the last one is cut, so that each source's words are exactly the rounded target. Sizes and hashes are
written once, without the texts; only sums by source and range of that order (``RANGES``, so that a source with
most of the rows is spread out) are shuffled, and where the copies end is sought in one range of each source.

Targets: the sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the words
of all sources; a target is at most ``most`` times its source's size, and the excess goes to the
others by weight until none is above. Sources are ranked in one task, a row of numbers each.

A null text has size 0. A document of size 0 is never taken; a very long one is a row like any other. A table without
words gets targets 0, an empty one no rows. Repeated rows share a hash; they are cut evenly where the copies end amid
them. doc_id may be of any type that can be a string. Columns of the input that have the name of one that mix()
adds (size, source_size, target, rate, taken) are left out; all others stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RANGES = 4096
BINS = 32
CLOSE, MOST_STEPS = 1e-12, 100
#: Rates are kept in steps of 2**-GRAIN, the order of copies in steps of 2**-(2 * GRAIN): integers, the same in all engines.
GRAIN = 20
#: Sources whose table of a few numbers each may be broadcast; with more, it is joined by shuffle with salt.
BROADCAST_ROWS = 20_000
SALT = 32
WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "rate", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of a document; SQL engines can tell it too."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def tilt(x: Column, size: Column, most: float) -> Column:
    return F.exp(F.least(x * size, F.lit(math.log(most))))


def grains(x: Column, size: Column, most: float) -> Column:
    """The rate in steps of 2**-GRAIN; 0 for a document without words."""
    return F.when(size > 0, F.least(F.floor(tilt(x, size, most) * (1 << GRAIN) + 0.5), F.lit(int(most * (1 << GRAIN))))).otherwise(0)


def order_of(h: Column, grain: Column) -> Column:
    """u - (r - floor(r)) in steps of 2**-(2 * GRAIN), of the hash h and the rate."""
    return F.shiftright(h, 60 - 2 * GRAIN) - F.shiftleft(grain.bitwiseAND(F.lit((1 << GRAIN) - 1)), GRAIN)


def _start(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """sources with low, high (around the root of its constraint) and x, the root for sizes parted into bins, by bisection."""
    near = F.floor(F.log2("size") * BINS)
    bins = sizes.where("size > 0").groupBy("source", near.alias("bin")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))
    # BINS times the octaves of sizes that there are: a bounded list
    bins = bins.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct((F.col("words") / F.col("n")).alias("size"), F.col("words").cast("double").alias("words"))).alias("bins"))
    ratio = F.col("target") / F.col("source_size")
    top = F.lit(math.log(most))
    # every size is 1 or more, so at ln(ratio) there are too few words, and at ln(most) all rates are at their limit
    state = sources.where("source_size > 0").withColumn("low", F.least(F.log(ratio), F.lit(0.0))).withColumn("high", F.when(ratio > 1, top).otherwise(0.0))
    words = lambda x: F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["words"] * tilt(x, b["size"], most))

    def halved(p: Column, _: Column) -> Column:
        middle = (p["low"] + p["high"]) / 2
        less = words(middle) < F.col("target")
        return F.struct(F.when(less, middle).otherwise(p["low"]).alias("low"), F.when(less, p["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct("low", "high"), halved)
    return state.join(bins, F.col("source").eqNullSafe(F.col("s"))).withColumn("x", (found["low"] + found["high"]) / 2).drop("s", "bins")


def solved(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """source, source_size, target, x (lambda) of each source that has words. sizes: source, size, n."""
    state = written(_start(sizes, sources, most), "mix-newton")
    for _ in range(MOST_STEPS):
        own = sizes.where("size > 0").join(state.select(F.col("source").alias("s"), "x"), F.col("source").eqNullSafe(F.col("s")))
        r = tilt(F.col("x"), F.col("size"), most)
        free = F.col("x") * F.col("size") < math.log(most)
        sums = own.groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("words"),
            F.sum(F.when(free, F.col("n") * F.col("size") * F.col("size") * r)).alias("slope"),
        )
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("off", F.col("words") - F.col("target"))
        low, high = F.when(F.col("off") < 0, F.col("x")).otherwise(F.col("low")), F.when(F.col("off") > 0, F.col("x")).otherwise(F.col("high"))
        next_ = F.col("x") - F.col("off") / F.col("slope")
        inside = F.coalesce((next_ >= low) & (next_ <= high), F.lit(False))
        done = F.abs("off") <= CLOSE * F.col("target")
        x = F.when(done, F.col("x")).when(inside, next_).otherwise((low + high) / 2)
        # no number between the ends: nothing is closer
        still = ~done & (x != low) & (x != high)
        state = written(
            now.select("source", "source_size", "target", low.alias("low"), high.alias("high"), x.alias("x"), still.alias("still")),
            "mix-newton",
        )
        if state.where("still").isEmpty():
            return state.select("source", "source_size", "target", "x")
    raise RuntimeError(f"mixing: no solution after {MOST_STEPS} steps")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size -> and weight, target. One row a source; the water level that caps share is found in closed form."""
    # Sources get capped in the order of most * size / weight. With the first j capped, the level is
    # (total - their caps) / (the others' weights), and j is the least one whose level the next source bears.
    ranked = sources.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(weights) + 1),
    )
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    total, caps = F.sum("source_size").over(every), F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - caps) / left
    t = ranked.withColumn("level", level).withColumn("bears", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    final = F.min(F.when(F.col("bears"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(every)["level"]
    cap = F.col("source_size") * most
    return t.select("source", "source_size", "weight", F.coalesce(F.least(final * F.col("weight"), cap), cap).cast("double").alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """A row a source: source, source_size, target, x (lambda), and where the extra copies end: documents whose place in the order is
    before edge get one more, those at it a share of ``numerator / denominator``."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    keyed = written(docs.select("source", key_of(F.col("doc_id"), F.col("text")).alias("h"), size_of(F.col("text")).alias("size")), "mix-keyed")
    sizes = written(keyed.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sources = written(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "mix-targets")
    tilts = solved(sizes, sources.select("source", "source_size", "target"), most)
    of_source = _joined(keyed.where("size > 0"), tilts.select("source", "x"), F.col("h"))
    grain = grains(F.col("_x"), F.col("size"), most)
    placed = of_source.select("source", "size", grain.alias("grain"), order_of(F.col("h"), grain).alias("v"))
    # a rate at the limit has no more copies
    free = F.when(F.col("grain") < int(most * (1 << GRAIN)), F.col("size")).otherwise(0)
    part = F.shiftright(F.col("v") + (1 << 2 * GRAIN), 2 * GRAIN + 1 - RANGES.bit_length() + 1).cast("int")
    whole = F.shiftright("grain", GRAIN) * F.col("size")
    parts = written(placed.groupBy("source", part.alias("part")).agg(F.sum(whole).alias("whole"), F.sum(free).alias("free")), "mix-ranges")
    need = parts.groupBy(F.col("source").alias("s")).agg(F.sum("whole").alias("whole")).join(tilts, same("source", "s"))
    need = need.select("s", (F.round("target").cast("long") - F.col("whole")).alias("missing")).where("missing > 0")
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reached = parts.withColumn("before", F.coalesce(F.sum("free").over(running), F.lit(0))).join(need, same("source", "s"))
    hit = reached.where("before < missing and missing <= before + free").select(
        "s", F.col("part").alias("p"), (F.col("missing") - F.col("before")).alias("rest"),
    )
    hit = written(hit, "mix-edges")
    # one range a source: its documents, a small share of the source's
    near = placed.withColumn("part", part).join(hit, same("source", "s") & (F.col("part") == F.col("p"))).groupBy("s", "rest", "v").agg(F.sum(free).alias("size"))
    upto = Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    edge = near.withColumn("sum", F.coalesce(F.sum("size").over(upto), F.lit(0))).where("sum < rest and rest <= sum + size")
    edge = edge.select("s", F.col("v").alias("edge"), (F.col("rest") - F.col("sum")).alias("numerator"), F.col("size").alias("denominator"))
    all_sources = sources.select("source", "source_size", "target").join(
        tilts.select(F.col("source").alias("t"), "x"), same("source", "t"), "left",
    ).drop("t")
    return written(all_sources.join(edge, same("source", "s"), "left").drop("s"), "mix-plan")


def _joined(rows: DataFrame, table: DataFrame, salt: Column) -> DataFrame:
    """rows with the columns of table, a row a source, as _<name>: broadcast where it has at most ``BROADCAST_ROWS`` rows, else joined
    by shuffle, salted."""
    table = table.select(F.col("source").alias("_s"), *(F.col(c).alias(f"_{c}") for c in table.columns if c != "source"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), same, "left").drop("_s")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(salted, same & (F.pmod(salt, F.lit(SALT)) == F.col("_salt")), "left").drop("_salt", "_s")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``docs`` with size, source_size, target, rate and taken (words that the mix takes of the document)."""
    table = plan(docs, weights, most)
    kept = [c for c in docs.columns if c not in ADDED]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "source", "doc_id", "text")
    sized = own.select("row", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("h"))
    joined = _joined(sized, table, F.col("h")).withColumn("grain", F.coalesce(grains(F.col("_x"), F.col("size"), most), F.lit(0)))
    joined = joined.withColumn("v", order_of(F.col("h"), F.col("grain")))
    part = F.expr("size * _numerator div _denominator")
    extra = F.when(F.col("grain") >= int(most * (1 << GRAIN)), 0).when(F.col("v") < F.col("_edge"), F.col("size")).when(F.col("v") == F.col("_edge"), part).otherwise(0)
    taken = (F.shiftright("grain", GRAIN) * F.col("size") + extra).cast("long")
    rate = F.col("grain") / F.lit(float(1 << GRAIN))
    return joined.select(
        "row.*", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), rate.alias("rate"),
        taken.alias("taken"),
    )


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that the mix consists of: one row a copy, ``columns`` only; a cut copy has the text's first words."""
    full = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    cut = F.array_join(
        F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.greatest(F.col("_n"), F.lit(1)).cast("int")),
        " ",
    )
    rows = mixed.withColumn("_rest", rest).withColumn(
        "_n",
        F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<bigint>")))),
    )
    rows = rows.withColumn("text", F.when(F.col("_n") >= 0, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n") >= 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(mixed.dtypes)["n_chars"]))
    return rows.select(*(F.col(f"`{c}`") for c in columns))
