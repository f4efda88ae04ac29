"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated down a tree of levels (domain, language, source).
A child never gets more than its subtree can give (its tokens times the number
of epochs allowed); what it cannot use goes to its siblings in proportion to
their weights, and only what all siblings cannot use stays with an ancestor's
siblings, because a parent already counts with its subtree's capacity. Each
leaf then takes whole epochs and the token-prefix of one more, in an order that
a seed and the epoch give.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import packed, unpacked, written

#: Levels of the query's tree and the weights of their names (others count 1).
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
_BIG = "decimal(26,0)"


def word_tokens(text: Column) -> Column:
    """Token measure: the number of runs without white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def domain_of(source: Column) -> Column:
    """One of four domains, by the source's name: the tables have no domain column."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.concat(F.lit("d"), F.translate(digit, "0123456789abcdef", "0123012301230123"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(10,0)")


def _share(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """``budget`` of each node from its parent's ``given``: by weight, up to the
    node's ``capacity``; the rest of a full node goes to its siblings."""
    all_ = Window.partitionBy(*parents)
    by_need = all_.orderBy(F.asc_nulls_last("need"), name)
    n = (nodes.withColumn("need", F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double")))
         .withColumn("before", F.coalesce(F.sum("capacity").over(by_need.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).cast(_BIG))
         .withColumn("heavier", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(12,0)"))
         .withColumn("full", F.expr("weight > 0 and capacity * heavier <= weight * (given - before)"))
         .withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_), F.lit(0)).cast(_BIG))
         .withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_), F.lit(0)).cast("decimal(12,0)")))
    part = F.expr("case when full then capacity when open > 0 then cast((weight * (given - taken)) div open as decimal(26,0))"
                  " else 0 end")
    return n.withColumn("budget", part.cast(_BIG)).drop("need", "before", "heavier", "full", "taken", "open")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
            share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget`` tokens for each.

    The whole budget is ``share`` (numerator, denominator) of all tokens. The
    tables here have a row per node of the tree.
    """
    leaves = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(_BIG))
    above = None
    for depth, level in enumerate(levels, 1):
        path, parents = list(levels[:depth]), list(levels[:depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast(_BIG).alias("capacity"),
                                          F.sum("tokens").cast(_BIG).alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights))
        if above is None:  # the children of the root, of which there are few
            nodes = nodes.withColumn("all", F.sum("tokens").over(Window.partitionBy()).cast(_BIG))
            nodes = nodes.withColumn("given", F.expr(f"cast((all * {share[0]}) div {share[1]} as {_BIG})"))
        else:
            nodes = nodes.join(above, parents)
        above = _share(nodes, parents, level).select(*path, F.col("budget").alias("given"))
    return leaves.drop("capacity").join(above.withColumnRenamed("given", "budget"), list(levels))


def _order(seed: int, epoch: Column, id_: Column) -> Column:
    """Place of a row in its leaf's epoch, as a string to sort by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def epochs(rows: DataFrame, levels: Sequence[str], plan: DataFrame, id_col: str, seed: int,
           bucket_digits: int = 3) -> DataFrame:
    """``plan`` with ``whole`` epochs and ``cutoff``: rows whose place in the next
    epoch is at or before it belong to the token-prefix.

    The prefix is found through sums over buckets of places, so that no task
    has to see all rows of a leaf: only the bucket in which the budget ends is
    summed row by row. Rows of one id share a place and go in together.
    """
    plan = plan.withColumn("whole", F.expr("case when tokens > 0 then budget div tokens else 0 end"))
    plan = plan.withColumn("rest", (F.col("budget") - F.col("whole") * F.col("tokens")).cast("long"))
    plan = written(plan.select(*levels, "tokens", "budget", "whole", "rest"), "mix-plan")
    placed = rows.join(plan.select(*levels, "whole", "rest").where("rest > 0"), list(levels)).select(
        *levels, "rest", "n_tokens", _order(seed, F.col("whole") + 1, F.col(id_col)).alias("place"))
    placed = placed.withColumn("bucket", F.substring("place", 1, bucket_digits))
    sums = placed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("bucket"))
    ends = (sums.withColumn("upto", upto).where("upto > rest").groupBy(*levels)
            .agg(F.min("bucket").alias("bucket"), F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("b")))["b"]
                 .alias("before")))
    inside = placed.join(ends, [*levels, "bucket"])
    run = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("place")
                                 .rangeBetween(Window.unboundedPreceding, 0))
    cut = (inside.withColumn("run", run + F.col("before")).groupBy(*levels, "bucket")
           .agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("place"))).alias("place")))
    cut = cut.select(*levels, F.coalesce("place", "bucket").alias("cutoff"))
    return plan.join(cut, list(levels), "left").withColumn(
        "cutoff", F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("cutoff", F.lit("g"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", levels: Sequence[str] = LEVELS,
        domain: Column | None = None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
        share: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 17,
        broadcast_leaves: int = 50_000) -> DataFrame:
    """The mixture: rows of ``docs`` with the levels, n_tokens and epoch (from 1);
    a row comes once for every epoch that takes it.

    ``share`` of all tokens is the budget; names without a weight count 1, a
    weight of 0 takes nothing. A null level is the empty name. Rows of one id
    (all null ids count as one) go in together; a leaf without tokens gives
    nothing; an empty table gives an empty result. Other columns, whatever
    their names, pass through, but for columns n_tokens and epoch, whose place
    the mixture's take; ``domain`` is computed where ``docs`` has no
    such column. Up to ``broadcast_leaves`` leaves are broadcast.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch")]
    names = {c.lower() for c in keep}
    d = docs if "domain" in names or "domain" not in levels else \
        docs.withColumn("domain", domain if domain is not None else domain_of(F.col("source")))
    keep = keep + [c for c in levels if c.lower() not in names]
    leaf = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    rows = written(d.select(F.col(id_col).alias("_id"), *leaf, word_tokens(F.col(text)).alias("n_tokens")), "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = written(epochs(rows, levels, budgets(leaves, levels, weights, share, max_epochs), "_id", seed), "mix-cutoffs")
    small = plan.count() <= broadcast_leaves
    marks = plan.select(*(F.col(c).alias(f"_leaf_{c}") for c in levels), F.col("whole").alias("_whole"),
                        F.col("cutoff").alias("_cutoff"))
    row, at = F.col("_row"), [c.alias(f"_at_{name}") for c, name in zip(leaf, levels)]
    on = [F.col(f"_at_{c}") == F.col(f"_leaf_{c}") for c in levels]
    out = d.select(packed(keep), *at).join(F.broadcast(marks) if small else marks, on)
    more = (_order(seed, F.col("_whole") + 1, row.getField(id_col)) <= F.col("_cutoff")).cast("long")
    out = out.withColumn("_n", F.col("_whole") + more).where("_n > 0")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(*unpacked(keep), word_tokens(row.getField(text)).alias("n_tokens"), F.col("_epoch").alias("epoch"))
