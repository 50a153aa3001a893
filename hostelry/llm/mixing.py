"""Mixing sources to target weights by weighted fair queueing.

The budget is the number of words of all documents. Sources in code point order (null last) take weights in turn and
share the budget by them; a source's target stops at ``passes`` times its own words, and what it leaves is shared
again by weight until no target is above its stop.

Every source is a queue of its documents in shuffled order, run through again up to ``passes`` times. A document's
virtual finish time is its source's words up to its end, divided by the source's target, so at time t every source has
been served t times its target, and the budget is spent at time 1. All queues are merged by one global range sort on
the finish time, and the merged queue is cut where the running total of served words reaches the budget: documents
that finish by then are whole, and the one that a source has in service gets the words due to it, which its
target rounds down. So every source's words miss its target by less than one.

The shuffle is a digest of seed, id and text: any run, plan or cluster gives the same mix.

Cases: a null text has size 0; a null source is a source, a null id an id; documents without words and documents of
sources without words are never served, and are returned with nothing taken; rows that are equal in id, source and
text are served one after the other (each has its own row); an empty table gives an empty table; other columns are
ignored whatever their names; a text of any length is one row. A source with a third of all rows is cut up
by its shuffled order like any other range of the sort, and equal rows are counted before they are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostelry.llm.ordering import running_totals
from hostelry.operators.distribution import spread_join
from hostelry.session import discard, durable

BLANKS = " \t\n\v\f\r"
#: Equal rows are listed again in steps of so many, so no row ever holds a long list.
STEP = 4096


def n_words(text: Column) -> Column:
    """Number of maximal runs of other characters than the six ASCII blanks (null: 0)."""
    inner = F.trim(text, F.lit(BLANKS))
    marks = F.regexp_replace(inner, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _long(number: int) -> Column:
    return F.lit(number).cast("long")


def targets(sources: DataFrame, weight_col: str, size_col: str, passes: int) -> DataFrame:
    """Adds ``target``: the whole size shared by weight, no source above ``passes`` times its size.

    A round shares what the stopped sources leave; each is one aggregate over the sources, and stops only ever grow,
    so rounds end by themselves. Only sums reach the driver.
    """
    # all whole numbers are longs: a literal of fewer bits would make a product of fewer bits
    size, weight = F.col(size_col).cast("long"), F.col(weight_col).cast("long")
    stop = size * passes
    budget = sources.agg(F.sum(size)).first()[0] or 0
    open_, open_weight, stopped = budget, None, -1
    while True:
        over = F.lit(False) if open_weight is None else _long(open_) * weight >= stop * _long(open_weight)
        now = sources.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, stop)).alias("held"), F.sum(F.when(~over, weight)).alias("weight")).first()
        if now["n"] == stopped or now["weight"] is None:
            break
        stopped, open_, open_weight = now["n"], budget - (now["held"] or 0), now["weight"]
    if open_weight is None:  # no sources
        return sources.withColumn("target", F.lit(0.0))
    share = (_long(open_) * weight).cast("double") / F.lit(open_weight).cast("double")
    return sources.withColumn("target", F.least(share, stop.cast("double")))


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = 3, seed: str = "0",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The merged queue, and behind it what the cut leaves out.

    One row per document and pass that is served (at least the first pass): the id, ``source``, ``digest`` (of seed,
    id and text), ``copy`` (number among equal rows), ``pass``, ``size``, ``source_size``, ``target``, ``finish``
    (virtual time), ``words`` (words taken, from the document's beginning) and ``offset`` (words of the mix before
    it; null where nothing is taken). Sort by ``offset`` for the mix itself.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("id_"), F.col(source_col).alias("source"), n_words(text).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))).alias("digest"))
    equal = durable(slim.groupBy("id_", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n")))
    sizes = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = running_totals(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1), "start": F.col("source_size")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = durable(targets(ranked.withColumn("weight", weight), "weight", "source_size", passes))
    discard(ranked)

    order = [F.col("source").asc_nulls_last(), F.col("digest"), F.col("id_"), F.col("size")]
    queues = spread_join(
        running_totals(equal, order, {"before": F.col("size") * F.col("n")}), sources.drop("weight", "rank"), ["source"])
    low = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP))).alias("low")
    one = F.explode(F.sequence(F.col("low"), F.least(F.col("low") + (STEP - 1), F.col("n") - 1))).alias("copy")
    each = queues.select("*", low).select("*", one).select("*", F.explode(F.array(*map(F.lit, range(passes)))).alias("pass"))
    ahead = F.col("before") - F.col("start") + F.col("copy") * F.col("size") + F.col("pass") * F.col("source_size")
    due = F.floor("target") - F.col("ahead")
    served = each.withColumn("ahead", ahead).withColumns({
        "words": F.greatest(F.lit(0), F.least(F.col("size"), due)),
        "finish": F.when(F.col("target") > 0, (F.col("ahead") + F.col("size")) / F.col("target"))})
    fields = ["id_", "source", "digest", "copy", "pass", "size", "source_size", "target", "finish", "words"]
    served = served.select(*fields)

    merged = running_totals(
        served.where("words > 0"), [F.col("finish"), F.col("source").asc_nulls_last(), F.col("digest"), F.col("copy"), F.col("pass")],
        {"offset": F.col("words")})
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cut = merged.withColumn("words", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("offset"))))
    left = served.where("words = 0 and pass = 0").withColumn("offset", F.lit(None).cast("long"))
    return cut.select(*fields, "offset").unionByName(left.select(*fields, "offset")).withColumnRenamed("id_", id_col)


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target``, ``taken`` (words over all passes), and the source."""
    per = mixed.groupBy(id_col, "source", "digest", "copy").agg(
        *[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("words").alias("taken"))
    return per.select(id_col, "size", "source_size", "target", "taken", "source")
