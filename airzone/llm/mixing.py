"""Mixing sources to target weights in a tree of domains, languages and sources.

A token budget flows down the tree by weight. A node cannot take more than its tokens times the allowed epochs; what
it leaves goes to its siblings first, and to its parent's siblings only when all of them are full. Each leaf then
takes the leading tokens of its documents in a seeded order, a new order for every epoch. Whole numbers only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from airzone.llm.common import keyed_unit, only, words
from airzone.sources.tables import stage


@dataclass(frozen=True)
class Mix:
    """``share`` per cent of all tokens is the budget, unless ``budget`` names it. ``weights`` maps a node, as the tuple of
    its names from the top, to a whole number up to 1000; other nodes weigh ``usual``. ``slice_rows`` is how many
    documents of a leaf are put in order by one task."""

    share: int = 60
    budget: int | None = None
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    usual: int = 10
    epochs: int = 3
    seed: str = "1"
    slice_rows: int = 20_000


def _filled(nodes: DataFrame, parent: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Children's shares of their parent's ``given`` tokens by ``weight``, none above its ``capacity``; adds ``own``.

    Children are ordered by capacity per weight. A child is full if its capacity is within its part of what the ones
    before it, all full, have left; once one is not full, no later one is. The others divide the rest by weight, rounded so
    that the parts add up.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), *keys)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_of, so_far = Window.partitionBy(*parent), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (nodes.where("weight > 0")
              .withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
              .withColumn("heavy", F.sum("weight").over(after))
              .withColumn("full", F.col("capacity") * F.col("heavy") <= (F.col("given") - F.col("taken")) * F.col("weight")))
    rest = (ranked.withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(all_of))
            .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_of))
            .withColumn("upto", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(so_far)))
    part = F.expr("left * upto DIV open - left * (upto - weight) DIV open")
    return rest.withColumn("own", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop(
        "taken", "heavy", "full", "left", "open", "upto")


def budgets(leaves: DataFrame, levels: Sequence[str], mix: Mix) -> DataFrame:
    """Leaves (``levels``, tokens) with ``budget``: how many tokens each is to give, epochs included.

    ``leaves`` is an aggregate: one row per leaf of the tree, however large the corpus. Leaves below a node of weight 0
    add nothing to the capacity of the nodes above them.
    """
    spark = leaves.sparkSession
    now = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("all"))
    given = F.lit(mix.budget) if mix.budget is not None else F.expr(f"all * {mix.share} DIV 100")
    above = total.select(F.lit(0).alias("one"), given.cast("long").alias("given"))
    depths = range(1, len(levels) + 1)
    for depth in depths:
        keys, weight = list(levels[:depth]), f"weight_{depth}"
        listed = [(*name, w) for name, w in mix.weights.items() if len(name) == depth]
        if listed:
            schema = ", ".join(f"`{k}` string" for k in keys) + f", {weight} long"
            now = now.join(spark.createDataFrame(listed, schema), keys, "left").withColumn(weight, F.coalesce(weight, F.lit(mix.usual)))
        else:
            now = now.withColumn(weight, F.lit(mix.usual).cast("long"))
        now = now.withColumn("capacity", F.when(F.col(weight) > 0, F.col("capacity")).otherwise(0))
    for depth in depths:
        keys, parent = list(levels[:depth]), list(levels[:depth - 1])
        nodes = now.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.max(f"weight_{depth}").alias("weight")).withColumn("one", F.lit(0))
        above = _filled(nodes.join(above, ["one", *parent]), ["one", *parent], keys).select("one", *keys, F.col("own").alias("given"))
    return leaves.join(above.drop("one").withColumnRenamed("given", "budget"), list(levels), "left").withColumn(
        "budget", F.coalesce("budget", F.lit(0)))


def mixed(docs: DataFrame, domain: Column, lang: Column, source: Column, mix: Mix = Mix(), id_col: str = "doc_id",
          text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as they are chosen, as ``r`` (a struct of all their columns), with domain, lang, source,
    n_tokens, epoch and taken.

    Tokens are words unless a column of counts is given. In epoch e a leaf's documents are ordered by a digest of seed, e and id
    (then id). A leaf takes whole epochs while its budget lasts and from the next the documents that begin within the
    rest; ``taken`` is the part of the last one that fits, so a leaf's ``taken`` add up to its budget. Where rows share the last
    one's id, each takes its share of that part, rounded down: then the leaf stays short by fewer tokens than there are such rows.

    A leaf of any size is put in order in slices: documents are counted by slices of the digest's range first, and only the
    documents of one slice are ordered together, by one task. Null names are a node "" of their own; null text has no
    tokens and is never chosen; rows that share an id (also null) share its room in the order; empty tables give no row.
    """
    weight = F.coalesce(tokens if tokens is not None else F.size(words(docs[text_col])), F.lit(0)).cast("long")
    names = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in (("domain", domain), ("lang", lang), ("source", source))}
    levels = list(names)
    rows = docs.select(F.struct("*").alias("r"), docs[id_col].cast("string").alias("id"), weight.alias("n_tokens"), *[c.alias(n) for n, c in names.items()]).where("n_tokens > 0")
    key = stage(rows.select(*levels, "id", "n_tokens"), "token-counts")      # texts are counted once for all sums
    leaves = stage(budgets(key.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), levels, mix), "leaf-budgets")
    # epochs that are taken whole, and the one that is cut
    plan = leaves.where("budget > 0").select(
        *levels, F.expr("budget DIV tokens").alias("whole"), F.expr("budget % tokens").alias("rest"),
        F.ceil(F.col("rows") / mix.slice_rows).cast("long").alias("slices"))
    wanted = key.join(plan, levels).where("rest > 0")
    order = keyed_unit(mix.seed, F.col("whole").cast("string"), F.coalesce("id", F.lit("")))
    placed = wanted.withColumn("at", order).withColumn("slice", F.floor(F.col("at") / F.lit(2 ** 52) * F.col("slices")).cast("long"))
    sums = placed.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*levels).orderBy("slice")) - F.col("n"))
    bounds = stage(sums.where("before < rest").select(*levels, "slice", "before", (F.col("before") + F.col("n") > F.col("rest")).alias("cut")), "slice-bounds")
    inside = placed.join(bounds, [*levels, "slice"])
    # one row per id of the cut slices: the tokens of the leaf before it
    ids = inside.where("cut").groupBy(*levels, "slice", "at", "id").agg(F.sum("n_tokens").alias("n"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    line = Window.partitionBy(*levels, "slice").orderBy("at", "id")
    # one row per leaf: the last id that begins within the rest; the ones before it fit, the ones behind it do not
    name = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit("")).alias("id"))
    edge = (ids.withColumn("start", F.col("before") + F.sum("n").over(line) - F.col("n")).where("start < rest")
            .groupBy(*levels).agg(F.max(F.struct("at", name.alias("name"), F.col("n").alias("n_"), F.least("n", F.col("rest") - F.col("start")).alias("room"))).alias("edge")))
    edge = stage(edge, "cut-documents")
    slots = (rows.join(plan, levels).withColumn("at", F.when(F.col("rest") > 0, order))
             .withColumn("slice", F.floor(F.col("at") / F.lit(2 ** 52) * F.col("slices")).cast("long"))
             .join(bounds.select(*levels, "slice", "cut"), [*levels, "slice"], "left").join(edge, levels, "left"))
    # texts stay where they are: all they are compared with is their leaf's edge
    here, last = F.struct("at", name.alias("name")), F.struct("edge.at", "edge.name")
    part = F.expr("CAST(edge.room AS DECIMAL(19, 0)) * CAST(n_tokens AS DECIMAL(19, 0)) DIV edge.n_")
    room = (F.when(F.col("cut") & (here == last), F.when(part > 0, part))
            .when(~F.col("cut") | (here < last), F.col("n_tokens")))
    every = slots.withColumn("room", room).withColumn("copies", F.col("whole") + F.col("room").isNotNull().cast("int")).where("copies > 0")
    return (every.withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)")))
            .select("r", *levels, "n_tokens", F.col("epoch").cast("long").alias("epoch"),
                    F.when(F.col("epoch") == F.col("whole"), F.least("n_tokens", "room")).otherwise(F.col("n_tokens")).alias("taken")))
