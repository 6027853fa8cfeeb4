"""Search tables: beams, tree nodes, and stored prefixes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.functions.text import has_answer_marker
from rollforge.sources.scratch import remove, written

# The weight of exploration in the upper confidence bound.
EXPLORATION = 1.41


def beam_prune(candidates: DataFrame, width: int) -> DataFrame:
    """The best candidates of each problem and step: previous score, 10 for an answer marker, less 0.001 a character.

    candidates: problem_id, step, idx, previous, response. done tells whether the best one has a marker.
    """
    marker = has_answer_marker("response")
    scored = candidates.withColumn("score", F.col("previous") + F.when(marker, 10.0).otherwise(0.0) - F.length("response") * 0.001)
    order = Window.partitionBy("problem_id", "step").orderBy(F.desc(F.round("score", 9)), "idx")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)
    return best.withColumn("done", (F.col("rank") == 1) & has_answer_marker("response"))


def ucb_rank(nodes: DataFrame, c: float = EXPLORATION, plus_one: bool = False) -> DataFrame:
    """Children by upper confidence bound under each parent; unvisited ones come first.

    plus_one takes the logarithm of the parent's visits plus one, as one family of searches does.
    """
    child, parent = nodes.alias("n"), nodes.select(F.col("problem_id").alias("tree"), F.col("node_id").alias("above"), F.col("visits").alias("parent_visits"))
    joined = child.join(parent, (F.col("n.problem_id") == F.col("tree")) & (F.col("n.parent_id") == F.col("above")))
    seen = F.log(F.col("parent_visits") + 1) if plus_one else F.log(F.greatest(F.col("parent_visits"), F.lit(1)))
    bound = F.round(F.col("value") / F.nullif(F.col("visits"), F.lit(0)) + c * F.sqrt(seen / F.nullif(F.col("visits"), F.lit(0))), 6)
    scored = joined.select("n.*", F.coalesce(bound, F.lit(float("inf"))).alias("ucb"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("problem_id", "parent_id").orderBy(F.desc("ucb"), "node_id")))


def reward_by_node(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Visits and value of each node with all its descendants, for the nodes that hang on a root.

    Pointer doubling: a node's pointer goes 1, 2, 4, ... levels up, and its sums hold the descendants that are nearer
    than that. In a round each node adds the sums of the nodes that point to it and takes the pointer of the one that it
    points to, so a chain of any depth takes log2(depth) + 1 rounds. Nodes below a parent that is not there, or in a
    circle, have no root. More than max_depth levels are an error. Every round is a written table.
    """
    key = ["problem_id", "node_id"]
    have = nodes.select(F.col("problem_id").alias("p"), F.col("node_id").alias("n"))
    there = nodes.hint("merge").join(have.hint("merge"), (F.col("problem_id") == F.col("p")) & (F.col("parent_id") == F.col("n")), "left")
    up = F.when(F.col("n").isNotNull(), F.col("parent_id"))
    state = written(there.select(*key, "visits", F.col("value").cast("double").alias("value"), up.alias("up"), (F.col("parent_id").isNotNull() & F.col("n").isNull()).alias("lost"), up.isNotNull().cast("long").alias("depth")), "nodes")
    n, reach = state.count(), 1
    while reach <= n and not state.where("up is not null").isEmpty():
        moving = state.where("up is not null")
        sums = moving.groupBy(F.col("problem_id").alias("p"), F.col("up").alias("u")).agg(F.sum("visits").alias("more_visits"), F.sum("value").alias("more_value"))
        ahead = state.select(F.col("problem_id").alias("p"), F.col("node_id").alias("u"), F.col("up").alias("next"), F.col("lost").alias("next_lost"), F.col("depth").alias("next_depth"))
        moved = moving.hint("merge").join(ahead.hint("merge"), (F.col("problem_id") == F.col("p")) & (F.col("up") == F.col("u")))
        moved = moved.select(*key, "visits", "value", F.col("next").alias("up"), (F.col("lost") | F.col("next_lost")).alias("lost"), (F.col("depth") + F.col("next_depth")).alias("depth"))
        after = moved.unionByName(state.where("up is null")).hint("merge").join(sums.hint("merge"), (F.col("problem_id") == F.col("p")) & (F.col("node_id") == F.col("u")), "left")
        before, state = state, written(after.select(*key, (F.col("visits") + F.coalesce("more_visits", F.lit(0))).alias("visits"), (F.col("value") + F.coalesce("more_value", F.lit(0.0))).alias("value"), "up", "lost", "depth"), "nodes")
        remove(before)
        reach *= 2
    rooted = state.where("up is null and not lost")
    if max_depth is not None and not rooted.where(F.col("depth") >= max_depth).isEmpty():
        raise ValueError(f"the tree is deeper than {max_depth} levels")
    return rooted.select(*key, "visits", "value")


#: A prefix is known by two independent 64-bit hashes, each the exclusive or over its tokens and their places.
SALTS = ("a", "b")


def _marks(tokens: Column, n: Column) -> list[Column]:
    """Both hashes of the first n tokens."""
    fold = lambda salt: F.aggregate(F.transform(F.slice(tokens, F.lit(1), n), lambda t, i: F.xxhash64(F.lit(salt), i, t)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return [fold(salt).alias(f"h{salt}") for salt in SALTS]


def _path(length: Column, most: int, rounds: int) -> Column:
    """The lengths up to its own that a binary search over 1..most looks at on its way to a length."""

    def step(state: Column, _: Column) -> Column:
        at = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        on, down = (state["lo"] <= state["hi"]) & (at <= length), (state["lo"] <= state["hi"]) & (at > length)
        return F.struct(F.when(on, at + 1).otherwise(state["lo"]).alias("lo"), F.when(down, at - 1).otherwise(state["hi"]).alias("hi"), F.when(on, F.concat(state["ms"], F.array(at))).otherwise(state["ms"]).alias("ms"))

    begun = F.struct(F.lit(1).alias("lo"), F.lit(most).alias("hi"), F.array().cast("array<int>").alias("ms"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begun, step)["ms"]


def prefix_markers(stored: DataFrame, most: int, rounds: int) -> DataFrame:
    """n, ha, hb, best: for each stored sequence the prefixes that a search for it looks at, and the longest stored sequence that starts each."""
    held = written(stored.where(F.size("tokens") > 0).select("tokens").distinct().select(F.monotonically_increasing_id().alias("s"), "tokens", F.size("tokens").alias("size")), "stored")
    at = held.select("s", "size", F.posexplode("tokens").alias("i", "t"))
    upto = Window.partitionBy("s").orderBy("i")
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), F.col("i"), F.col("t"))).over(upto).alias(f"h{salt}") for salt in SALTS]
    prefixes = written(at.select("s", "size", (F.col("i") + 1).alias("n"), *marks), "prefixes")
    whole = prefixes.where(F.col("n") == F.col("size")).select("n", "ha", "hb")
    inner = prefixes.hint("merge").join(whole.hint("merge"), ["n", "ha", "hb"]).select("s", F.col("n").alias("inner"))
    looked = held.select("s", F.explode(_path(F.col("size"), most, rounds)).alias("n"))
    looked = looked.hint("merge").join(prefixes.select("s", "n", "ha", "hb").hint("merge"), ["s", "n"])
    best = looked.hint("merge").join(inner.hint("merge"), "s").groupBy("n", "ha", "hb").agg(F.coalesce(F.max(F.when(F.col("inner") <= F.col("n"), F.col("inner"))), F.lit(0)).alias("best"))
    best = written(best, "markers")
    remove(held, prefixes)
    return best


def longest_prefix_join(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """query_id, matched, hit: the longest stored token sequence that starts each query.

    A binary search over lengths: a query asks for its prefix of one length; a marker there says that longer stored
    sequences may follow, and which is the longest so far. A query takes log2(longest stored) + 1 questions, each one
    small row that is shuffled, and its tokens stay where they are. Prefixes are compared by 128 bits. Repeated and null
    query_ids are answered each; null and empty sequences start nothing.
    """
    longest = stored.agg(F.max(F.size("tokens")).alias("n")).first().n or 0
    asked = queries.select(F.monotonically_increasing_id().alias("q"), "query_id", "tokens")
    if longest < 1:
        return asked.select("query_id", F.lit(0).alias("matched"), F.lit(False).alias("hit"))
    rounds = longest.bit_length()
    markers = prefix_markers(stored, longest, rounds)
    asked = written(asked, "asked")
    held = asked.select("q", F.col("tokens")).repartition("q").persist(StorageLevel.MEMORY_AND_DISK)
    state = written(asked.select("q", "query_id", F.lit(1).alias("lo"), F.lit(longest).alias("hi"), F.lit(0).alias("matched")), "state")
    for _ in range(rounds):
        at = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        open_ = state.where("lo <= hi").withColumn("n", at)
        probes = open_.hint("merge").join(held.hint("merge"), "q").where(F.col("n") <= F.size("tokens"))
        found = probes.select("q", "n", *_marks(F.col("tokens"), F.col("n"))).hint("merge").join(markers.hint("merge"), ["n", "ha", "hb"]).select(F.col("q").alias("own"), "best")
        told = state.hint("merge").join(found.hint("merge"), F.col("q") == F.col("own"), "left")
        hit, going = F.col("best").isNotNull(), F.col("lo") <= F.col("hi")
        step = told.select("q", "query_id", F.when(hit, at + 1).otherwise(F.col("lo")).alias("lo"), F.when(going & ~hit, at - 1).otherwise(F.col("hi")).alias("hi"), F.greatest("matched", F.coalesce("best", F.lit(0))).alias("matched"))
        before, state = state, written(step, "state")
        remove(before)
    held.unpersist()
    remove(markers, asked)
    return state.select("query_id", "matched", (F.col("matched") > 0).alias("hit"))
