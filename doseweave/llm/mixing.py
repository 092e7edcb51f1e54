"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document waits in its source's queue in hash order. Its virtual finish time is the source's cumulative words
divided by the source's target, counted on through a second round of the same queue where the target is above the
source's size. The global order of finish times is cut at the total budget. Up to finish time 1 no source is above
its target, so that part always fits; of the documents that finish later only the one that each source is in the
middle of can follow, if more than half of it comes before time 1, in the order of these half-way times, each if the
budget still has room for it. Documents stay whole, and a source ends within half a document of its target as far as
the budget allows. Rows equal in id and text stand at one place of the queue and are taken one by one.

A queue is never one task: cumulative words are the totals of earlier (source, hash bucket) pairs, a small table,
plus a window inside the bucket. Since a queue is taken from its front, the result is one cut per source and round,
and the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.llm.common import durable
from doseweave.plans.ordering import hash_bucket, positions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def queued(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size`` (words; null text: 0) and ``_prio``, the place in the source's queue (md5 of id and text)."""
    place = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text), F.lit(WORD)))
    return docs.withColumns({"size": size.cast("long"), "_prio": F.md5(place)})


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target``.

    Sources by code point (null last) take the weights in turn and share ``share`` of all words. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight. Sources reach their stop in the order
    of stop / weight, so running sums over the sources give the level that follows each of them. Stopping a source
    below the level raises it for the others and stopping one above lowers it, so the highest level is the one.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    ).withColumn("stop", F.col("source_size") * most)
    whole = Window.partitionBy()
    earlier = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    stopped = F.coalesce(F.sum("stop").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    level = weighted.withColumn("_level", (budget - stopped) / open_weight)
    target = F.least(F.col("stop").cast("double"), F.max("_level").over(whole) * F.col("weight"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def queue(sized: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """The queue of each source, one row per place and round; targets of 0 are left out.

    ``n`` rows that agree in id and text stand at one place, one after the other, with ``ahead`` words before them. The
    first ``early`` of them finish by virtual time 1.
    """
    places = sized.groupBy("source", "_prio", "size").agg(F.count(F.lit(1)).alias("n"))
    tagged = places.withColumns({"_bucket": hash_bucket(F.col("_prio")), "_all": F.col("size") * F.col("n")})
    totals = tagged.groupBy("source", "_bucket").agg(F.sum("_all").alias("_all"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_prio", "size")
    counted = tagged.withColumn("_in", F.sum("_all").over(inside) - F.col("_all"))
    joined = counted.alias("q").join(
        offsets.alias("o"),
        F.col("q.source").eqNullSafe(F.col("o.source")) & (F.col("q._bucket") == F.col("o._bucket")),
    ).select("q.source", "_prio", "size", "n", (F.col("_before") + F.col("_in")).alias("_run"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round")
    times = (
        joined.alias("q")
        .join(targets.filter("target > 0").alias("t"), F.col("q.source").eqNullSafe(F.col("t.source")))
        .select("q.source", "_prio", "size", "n", "_run", "source_size", "target", rounds)
        .withColumn("ahead", F.col("round") * F.col("source_size") + F.col("_run"))
    )
    # The quotient may be off by one in doubles, so the three whole numbers around it are tried.
    guess = F.floor((F.col("target") - F.col("ahead")) / F.col("size"))
    fits = lambda k: F.col("ahead") + k * F.col("size") <= F.col("target")
    whole = F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)
    early = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), whole)))
    return times.withColumn("early", early.otherwise(F.when(fits(F.lit(0)), F.col("n")).otherwise(0)))


def _that_fit(late: DataFrame, room) -> DataFrame:
    """Of the documents over the line (at most one per source and round) those that still fit, first come first."""
    order = ("half", "last", "source", "round", "cut", "size")
    line = late.withColumn("last", F.col("source").isNull()).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("line")).withColumn("room", room)
    nobody = F.filter("line", lambda x: F.lit(False))

    def take(done, x):
        fits = x["size"] <= done["room"]
        return F.struct(
            F.when(fits, done["room"] - x["size"]).otherwise(done["room"]).alias("room"),
            F.when(fits, F.concat(done["kept"], F.array(x))).otherwise(done["kept"]).alias("kept"),
        )

    start = F.struct(F.col("room").cast("long").alias("room"), nobody.alias("kept"))
    return line.select(F.explode(F.aggregate("line", start, take)["kept"]).alias("x")).select("x.source", "x.round", "x.cut")


def source_cuts(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets plus ``cuts``: per round the last place in the source's queue that the mix takes (null: none), and how
    many (``taken``) of the ``n`` equal rows there."""
    targets = durable(source_targets(sized, weights, share, most))
    items = durable(_at_the_line(queue(sized, targets, most)))
    budget = targets.agg(F.coalesce(F.floor(F.sum("source_size") * F.lit(float(share))), F.lit(0)).alias("b")).scalar()
    room = budget - items.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).scalar()
    late = items.filter("late IS NOT NULL").select("source", "round", "late.half", "late.cut", "late.cut.size")
    taken = items.filter("cut IS NOT NULL").select("source", "round", "cut").union(_that_fit(late, room))
    cuts = taken.groupBy("source").agg(
        *[F.max(F.when(F.col("round") == r, F.col("cut"))).alias(f"_cut{r}") for r in range(most)]
    )
    return durable(
        targets.alias("t")
        .join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select("t.source", "source_size", "target", F.array(*[f"_cut{r}" for r in range(most)]).alias("cuts"))
    )


def _at_the_line(items: DataFrame) -> DataFrame:
    """Per source and round the last place that finishes in time, the ``words`` up to it and the row over the line."""
    cut = lambda k: F.struct("_prio", "size", k.cast("long").alias("taken"), "n")
    middle = F.col("ahead") + F.col("early") * F.col("size") + F.col("size") / 2
    over = (F.col("size") > 0) & (F.col("early") < F.col("n")) & (middle <= F.col("target"))
    late = F.struct((middle / F.col("target")).alias("half"), cut(F.col("early") + 1).alias("cut"))
    return items.groupBy("source", "round").agg(
        F.max(F.when(F.col("early") > 0, cut(F.col("early")))).alias("cut"), F.sum(F.col("early") * F.col("size")).alias("words"),
        F.min(F.when(over, late)).alias("late"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` (all its columns) with ``size``, ``source_size``, ``target``, ``rounds`` and ``taken``.

    ``rounds`` is how often the mix takes the document, ``taken`` the words that makes. Null texts and texts without
    a word have size 0 and take nothing. A null source is a source of its own, last in turn. Rows equal in id and
    text are taken one by one, in the order of a hash of their other columns. An empty table gives an empty result.
    Columns of ``docs`` named like the added ones are replaced.
    """
    names = {"size", "source_size", "target", "rounds", "taken"}
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in names and not c.startswith("_")])
    sized = durable(queued(docs).select("doc_id", "source", "size", "_prio"))
    cuts = source_cuts(sized, weights, share, most)
    return _decided(docs, queued(docs), cuts)


def _numbered(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``_number``, the place among equal rows where a cut goes through them; elsewhere 1, since it doesn't matter."""
    through = cuts.select("source", F.explode("cuts").alias("cut")).filter("cut.taken < cut.n").select("source", "cut._prio", "cut.size").distinct()
    if through.isEmpty():
        return rows.withColumn("_number", F.lit(1))
    same = F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d._prio") == F.col("x._prio")) & (F.col("d.size") == F.col("x.size"))
    hashable = [f"`{c}`" for c, kind in rows.dtypes if not any(k in kind for k in ("map<", "variant"))]
    key = F.concat_ws("|", "_prio", F.col("size").cast("string"), F.col("source").isNull().cast("string"), F.col("source").cast("string"))
    cut = durable(
        rows.alias("d").join(through.alias("x"), same, "left_semi")
        .withColumns({"_tie": F.xxhash64(*hashable), "_mid": F.monotonically_increasing_id(), "_key": key})
    )
    part = F.struct("_tie", F.shiftright("_mid", 33))
    numbered = positions(cut, ["_tie", "_mid"], part, by=["_key"], name="_number").drop("_tie", "_mid", "_key")
    whole = rows.alias("d").join(through.alias("x"), same, "left_anti").withColumn("_number", F.lit(1))
    return whole.unionByName(numbered)


def _decided(docs: DataFrame, rows: DataFrame, cuts: DataFrame) -> DataFrame:
    def taken(cut):
        last = F.struct(cut["_prio"].alias("p"), cut["size"].alias("s"), cut["taken"].alias("n"))
        return last >= F.struct(F.col("d._prio").alias("p"), F.col("d.size").alias("s"), F.col("d._number").cast("long").alias("n"))

    rounds = F.aggregate(
        F.col("c.cuts"), F.lit(0), lambda n, cut: n + F.when(cut.isNotNull() & taken(cut), F.lit(1)).otherwise(F.lit(0))
    )
    return (
        _numbered(rows, cuts).alias("d")
        .join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
        .select(*[F.col(f"d.`{c}`") for c in docs.columns], "d.size", "c.source_size", "c.target", rounds.alias("rounds"))
        .withColumn("taken", F.col("rounds") * F.col("size"))
    )


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The decisions of ``mixed`` per document without its text: the text is read once."""
    sized = durable(queued(docs).select("doc_id", "source", "size", "_prio"))
    cuts = source_cuts(sized, weights, share, most)
    return _decided(sized.select("doc_id", "source"), sized, cuts)


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed documents themselves with the columns of ``docs``: a document taken twice is two rows."""
    names = [f"c{i}" if c not in ("doc_id", "text", "source") else c for i, c in enumerate(docs.columns)]
    copies = mixed(docs.toDF(*names), weights, share, most).filter("rounds > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    return copies.select(*names).toDF(*docs.columns)
