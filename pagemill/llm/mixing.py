"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the copy rate target / source_size. Its whole
part is taken at once; fractional parts are rounded in a reduction tree: groups
of at most a few hundred documents walk through pairs and move mass between the
two until one of them is integral. The move keeps size_i * p_i + size_j * p_j, so
a source's words stay at its target whatever is drawn. Each group passes up its
one fractional document and, unrounded, some of all sizes.

Walks go from large to small. Where the documents behind the carrier can give or take
less than SLACK times its words, chance may no longer make it
integral: it is rounded by its probability, or to the side that they can make good, and the words that this adds or lacks
go to the next, smaller document, and on; what is left at last goes up. So a source misses its target by less than
one of its smallest documents, as long as smaller documents can take what larger ones leave.

Only built-in functions run. Draws are hashes of ids and a seed: reruns agree.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, the last; equal rows are documents of their own; a source
with no words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents that one node of the reduction tree rounds together, on average.
FAN_IN = 128
#: Of a node's documents by size, each so-manyth is passed on as it is: the top needs documents of all sizes.
STRIDE = 8
#: Words that the documents behind a carrier can give and take, as a multiple of its size, from which it is left to chance.
SLACK = 4
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one a source.

    Capped proportional shares in closed form: with sources by cap / weight, the
    first ones are at their cap as long as their level stays below the common one.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # one row a source; a window over sources, not over documents
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_copies).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double") * share)
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("common", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    # the first source whose level is not reached sets the common level of all after it
    s = s.withColumn("at_cap", F.col("level") <= F.col("common"))
    s = s.withColumn("lam", F.max(F.when(~F.col("at_cap"), F.col("common"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("at_cap") | F.col("lam").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lam") * F.col("weight"))).alias("target"))


def _unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) drawn from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def pivot_groups(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: rows (source, bucket, uid, size, p) -> (source, uid, size, p, settled).

    The walk's state is the fractional carrier (uid, size, p), the rows settled, and of those not yet walked through the words and the words at their rates.
    """
    item = "struct<uid:long,size:long,p:double>"
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "uid", "size", "p")))
    one = lambda uid, size, p: F.struct(uid.alias("uid"), size.alias("size"), p.alias("p"))
    snap = lambda p: F.when(F.abs(p) < EPS, 0.0).when(F.abs(p - 1.0) < EPS, 1.0).otherwise(p)
    whole = lambda s: (s["p"] == 0.0) | (s["p"] == 1.0)
    drawn = lambda c: F.when(_unit(c["uid"], F.lit(seed), F.lit(-1)) < c["p"], 1.0).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        c, left, mass = acc["c"], acc["left"] - x["size"], acc["mass"] - x["p"] * x["size"]
        state = lambda c, done: F.struct(c.cast(item).alias("c"), done.alias("done"), left.alias("left"), mass.alias("mass"))
        # carrier with p in (0,1) against x: move words from x to c, or from c to x
        up = F.least((1.0 - c["p"]) * c["size"], x["p"] * x["size"])  # c gains, x loses
        down = F.least(c["p"] * c["size"], (1.0 - x["p"]) * x["size"])  # c loses, x gains
        gain = _unit(c["uid"], x["uid"], F.lit(seed), F.lit(level)) * (up + down) < down
        moved = F.when(gain, up).otherwise(-down)
        c2, x2 = one(c["uid"], c["size"], snap(c["p"] + moved / c["size"])), one(x["uid"], x["size"], snap(x["p"] - moved / x["size"]))
        walked = F.when(whole(c2) & whole(x2), state(F.lit(None), F.concat(acc["done"], F.array(c2, x2)))).when(whole(c2), state(x2, F.concat(acc["done"], F.array(c2)))).otherwise(state(c2, F.concat(acc["done"], F.array(x2))))
        # beyond chance the carrier is rounded, x takes over its words
        room = acc["left"] - acc["mass"]
        gives, takes = (1.0 - c["p"]) * c["size"] <= acc["mass"], c["p"] * c["size"] <= room
        to = F.when((c["p"] <= 0.0) | (c["p"] >= 1.0) | (gives & takes), drawn(c)).when(gives, 1.0).when(takes, 0.0).otherwise(F.round(c["p"]))
        rounded = one(c["uid"], c["size"], to)
        taken = one(x["uid"], x["size"], snap(x["p"] + (c["p"] - to) * c["size"] / x["size"]))
        chance = (c["p"] > 0.0) & (c["p"] < 1.0) & (F.least(acc["mass"], room) >= SLACK * c["size"])
        walked = F.when(chance, walked).otherwise(state(taken, F.concat(acc["done"], F.array(rounded))))
        return F.when(c.isNull(), state(one(x["uid"], x["size"], x["p"]), acc["done"])).otherwise(walked)

    none = F.array().cast(f"array<{item}>")
    grouped = rows.groupBy("source", "bucket").agg(ordered.alias("items"))
    held = F.array().cast("array<struct<neg:long,uid:long,size:long,p:double>>") if last else F.filter("items", lambda x, i: i % STRIDE == STRIDE - 1)
    grouped = grouped.select("source", F.col("items") if last else F.filter("items", lambda x, i: i % STRIDE != STRIDE - 1).alias("items"), held.alias("held"))
    words = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    mass = F.aggregate("items", F.lit(0.0), lambda n, x: n + x["p"] * x["size"])
    start = F.struct(F.lit(None).cast(item).alias("c"), none.alias("done"), words.alias("left"), mass.alias("mass"))
    walked = grouped.select("source", "held", F.aggregate("items", start, step).alias("acc"))
    c = F.col("acc.c")
    tail = F.when(c.isNull(), none).otherwise(F.array(one(c["uid"], c["size"], drawn(c) if last else c["p"])))
    held = F.transform("held", lambda x: one(x["uid"], x["size"], x["p"]))
    out = walked.select("source", F.explode(F.concat("acc.done", tail, held)).alias("i")).select("source", "i.*")
    return out.withColumn("settled", (F.col("p") == 0.0) | (F.col("p") == 1.0))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_copies: int = 3, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, size, source_size, target, taken, copies, source, row_id); row_id: hash of id and text."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal rows count together and part again by an ordinal: no window over documents
    sized = sized.groupBy("doc_id", "row_id", "source", "size").agg(F.count("*").alias("n"))
    sized = materialize(sized.select("doc_id", "row_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")), "mix-sizes")
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).select("source", "source_size"), weights, share, max_copies), "mix-targets")
    named = sized.withColumn("uid", F.xxhash64("row_id", "source", "k"))
    rated = named.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0)).withColumn("whole", F.floor(F.col("rate") + EPS).cast("long"))
    rated = rated.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    live = rated.where(F.col("p") > EPS).select(F.col("source"), "uid", "size", "p")
    # nodes of a level by the rows of the largest source: a number of levels, not rows, reaches the driver
    counts = live.groupBy("source").agg(F.count("*").alias("rows"))
    most = counts.agg(F.max("rows")).first()[0] or 0
    counts = materialize(counts, "mix-counts")
    # what a level leaves: of each node the documents passed on and a fractional one
    shrink, left = [], float(most)
    while left > FAN_IN:
        shrink.append(FAN_IN if not shrink else shrink[-1] * FAN_IN / (FAN_IN // STRIDE + 1))
        left = left / FAN_IN * (FAN_IN // STRIDE + 1)
    levels, settled = len(shrink) + 1, None
    for level in range(levels):
        nodes = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(float(shrink[level])))) if level < levels - 1 else F.lit(1)
        placed = live.join(counts.withColumnRenamed("source", "s"), live["source"].eqNullSafe(F.col("s"))).select("source", F.pmod(F.xxhash64("uid", F.lit(seed), F.lit(level)), nodes.cast("long")).alias("bucket"), "uid", "size", "p")
        out = materialize(pivot_groups(placed, level, seed, level == levels - 1), f"mix-level{level}")
        done = out.where("settled").select("uid", "size", "p")
        settled = done if settled is None else settled.unionByName(done)
        live = out.where(~F.col("settled")).select("source", "uid", "size", "p")
    extra = settled.select("uid", "size", F.col("p").cast("long").alias("extra"))
    out = rated.join(extra, ["uid", "size"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "row_id")
