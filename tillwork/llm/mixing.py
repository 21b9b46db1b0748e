"""Mixing sources to target weights by entropy balancing.

Rates of documents are the closest to one, in relative entropy, that give each source its
target number of words while no document is taken more often than the cap: an exponential
tilt min(cap, exp(lambda * size)), one lambda per source. The convex dual is solved by
distributed Newton iterations over counts of equal sizes, kept inside a bracket; the driver
sees one number per iteration. Rates are then rounded into whole copies so that, over the
documents of a source in order of size, the running sum is never off by more than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash
from tillwork.llm.linequality import word_array

ROUNDS = 60
CLOSE = 1e-6  # of the target, or of a thousand words where the target is less
GROUP_ROWS = 50_000  # documents ranked in one group


def _exact(value) -> F.Column:
    """Sum of millionths, the same in any order of the rows."""
    return F.sum(F.round(value * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def source_targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Source, its size, number of documents and target.

    Targets go by weight and stop at ``cap`` times the source's size; what is over is shared
    again by weight among the others until none is above. One row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"),
                                            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = stash(by_source.withColumn("weight", weight), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, None  # target of a weight of one; how many sources are held at the cap
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * cap
        row = sources.agg(F.sum(F.when(over, F.col("source_size"))).alias("full"), F.count_if(over).alias("n"),
                          F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row["n"] == stopped or not row["weight"]:
            break
        if level is not None:
            stopped = row["n"]
        level = (total - cap * (row["full"] or 0)) / row["weight"]
    return sources.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * float(level or 0.0)))


def tilts(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """The tilt of each source: ``lambda`` such that its rates give its target.

    ``sizes``: source, size, n. Null where every document is taken at the cap; 0 for a
    source without words.
    """
    mean = F.col("source_size") / F.col("n")
    x = F.col("size") / F.col("mean")
    least_x = F.col("least_size") / F.col("mean")
    state = sources.select("source", mean.alias("mean"), "target", "source_size", "least_size").withColumn(
        "open", (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap))
    low = F.least(F.lit(0.0), F.log(F.greatest(F.col("target"), F.lit(1e-6)) / F.col("source_size")) / least_x)
    state = state.withColumns({"lo": F.when(F.col("open"), low), "hi": F.when(F.col("open"), F.log(F.lit(float(cap))) / least_x),
                               "tilt": F.when(F.col("open"), F.lit(0.0))})
    state = stash(state, "tilts")
    for _ in range(ROUNDS):
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        inner = F.when(rate < cap, rate * x).otherwise(0.0)
        words = F.col("n") * F.col("size")
        mine = state.filter("open").select(F.col("source").alias("s"), "mean", "tilt")
        seen = sizes.filter("size > 0").join(mine, sizes["source"].eqNullSafe(mine["s"])).groupBy("source").agg(
            _exact(words * rate).alias("taken"), _exact(words * inner).alias("slope")).withColumnRenamed("source", "s")
        step = state.join(seen, state["source"].eqNullSafe(seen["s"]), "left").drop("s")
        gap = F.col("taken") - F.col("target")
        step = step.withColumns({"lo": F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")),
                                 "hi": F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi")),
                                 "newton": F.col("tilt") - gap / F.nullif("slope", F.lit(0.0)),
                                 "miss": F.abs(gap) / F.greatest(F.col("target"), F.lit(1000.0))})
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        new = F.when(F.col("miss") <= CLOSE, F.col("tilt")).when(inside, F.col("newton")).otherwise(
            (F.col("lo") + F.col("hi")) / 2)
        state = stash(step.withColumn("tilt", F.when(F.col("open"), new)).drop("newton", "taken", "slope"), "tilts")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= CLOSE:
            break
        state = state.drop("miss")
    return state.select("source", "mean", "open", "target", "source_size", F.round("tilt", 12).alias("tilt"))


def closer(rated: DataFrame, cap: int, rounds: int = 3) -> DataFrame:
    """Spend the words by which each source misses its target on documents no larger than the miss.

    Rounding copies may leave out a very long document that smaller ones can make up for. Per round
    the largest sizes come first; what is left then is less than the size at which it stopped.
    """
    of_source = Window.partitionBy("source")
    larger = of_source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(rounds):
        rated = rated.withColumn("gap", F.col("target") - F.sum(F.col("group_copies") * F.col("size")).over(of_source))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("group_copies")).otherwise(F.col("group_copies"))
        rated = rated.withColumn("room", F.when(fits, room).otherwise(0))
        spent = F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        more = F.floor((F.abs("gap") - spent) / F.greatest("size", F.lit(1)))
        step = F.greatest(F.least(F.col("room"), more), F.lit(0))
        rated = rated.withColumn("group_copies", (F.col("group_copies") + F.signum("gap") * step).cast("long"))
    taken = F.sum(F.col("group_copies") * F.col("size")).over(of_source)
    return rated.drop("gap", "room").withColumn("miss", F.try_divide(taken - F.col("target"), F.col("target")))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = (5, 2, 1),
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``, ``miss``.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share``
    times all words; no target is above ``cap`` times the words of its source, no document is
    taken more than ``cap`` times. ``taken`` = ``copies`` times ``size``. What a source is off its target
    after rounding is spent on documents that fit in it (``closer``); ``miss`` is what remains, as a share
    of the target. Reruns agree.

    A null text has size 0; a null source is a source; rows without words are taken once, or
    ``cap`` times in a source taken whole at the cap; repeated rows are documents of their own,
    which of them gets a copy more makes no difference. No rows give no rows.
    """
    named = columns(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    sized = stash(named.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size")), "sizes")
    sizes = stash(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    tilt = tilts(sizes, source_targets(sized, share, cap, weights), cap).withColumnRenamed("source", "s")

    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    rate = F.when(F.col("open"), tilted).when(F.col("source_size") > 0, F.lit(float(cap))).otherwise(F.lit(1.0))
    rated = sizes.join(tilt, sizes["source"].eqNullSafe(tilt["s"])).withColumn("rate", rate)
    run = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size"))
    rated = rated.withColumn("upto", F.floor(run + 0.5)).withColumn(
        "group_copies", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
    rated = closer(rated, cap)
    rated = rated.select("s", "size", "n", "source_size", "target", "rate", "miss", "group_copies").withColumnRenamed("size", "of_size")

    # Documents of a group differ by one copy at most; which get it goes by rank, in parts of bounded size.
    parts = (sizes.agg(F.max("n")).first()[0] or 0) // GROUP_ROWS + 1
    salted = sized.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(parts)))
    in_part = salted.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    planned = in_part.join(rated, in_part["source"].eqNullSafe(rated["s"]) & (in_part["size"] == rated["of_size"]))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part"))
    extra = F.col("group_copies") % F.col("n")
    planned = planned.withColumn("upto", upto).select(
        F.col("source").alias("s"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), "source_size", "target", "rate", "miss",
        F.floor(F.col("group_copies") / F.col("n")).alias("each"),
        (F.floor(extra * F.col("upto") / F.col("n")) - F.floor(extra * (F.col("upto") - F.col("m")) / F.col("n"))).alias("more"))
    order = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    ranked = salted.withColumn("place", F.row_number().over(order))
    joined = ranked.join(planned, ranked["source"].eqNullSafe(planned["s"]) & (ranked["size"] == planned["of_size"])
                         & (ranked["part"] == planned["of_part"]))
    copies = (F.col("each") + (F.col("place") <= F.col("more")).cast("int")).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"), "miss")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           **settings) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it.

    Rows that share id, source and size share the copies that the mix takes of them evenly, also those
    without an id.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    group = ["__id", "__source", "__size"]
    taken = taken.groupBy(*[F.col(c).alias(g) for c, g in zip(("doc_id", "source", "size"), group)]).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    of = [docs[f"`{c}`"] for c in (id_col, source_col)] + [F.size(word_array(docs[f"`{text_col}`"])).cast("long")]
    marked = docs.withColumns({f"{g}_of": c for g, c in zip(group, of)})
    same = F.lit(True)
    for g in group:
        same = same & marked[f"{g}_of"].eqNullSafe(taken[g])
    joined = marked.join(taken, same)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.col(f"`{text_col}`"))))
    times = F.floor(F.col("__copies") / F.col("__rows")) + (place <= F.col("__copies") % F.col("__rows")).cast("int")
    joined = joined.withColumn("__times", times.cast("int")).filter("__times > 0")
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
