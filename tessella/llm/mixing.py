"""Mixing sources to target weights: budgets down a tree, then seeded epochs of each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, fits_broadcast, materialize

LEVELS = ("__domain", "__lang", "__source")
#: Target weights by level and name, as the query and the pipeline use them; names not listed have 1.
TARGETS = (
    (0, "d0", 3.0), (0, "d1", 1.0), (0, "d2", 2.0), (0, "d3", 2.0),
    (1, "en", 4.0), (1, "fr", 3.0), (1, "de", 2.0), (1, "es", 1.0),
    (2, "src1", 5.0), (2, "src2", 3.0), (2, "src7", 2.0), (2, "src10", 0.5), (2, "src12", 0.0),
)


def targets(spark: SparkSession, weights: tuple[tuple[int, str, float], ...] = TARGETS) -> DataFrame:
    return spark.createDataFrame(list(weights), "level int, name string, weight double")


def tree(docs: DataFrame, domains: int = 4) -> DataFrame:
    """docs plus __domain, __lang, __source and __tokens (words). The tables have no domain, so
    sources are dealt to `domains` groups by the first digit of their MD5. Nulls count as ''."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    digit = F.conv(F.substring(F.md5(source.cast("binary")), 1, 1), 16, 10).cast("int")
    columns = {"__domain": F.concat(F.lit("d"), digit % domains), "__lang": lang, "__source": source}
    return docs.withColumns(columns | {"__tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})


def _rank(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in a seeded epoch: an order that any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def budgets(leaves: DataFrame, total: int, levels: tuple[str, ...] = LEVELS, weights: DataFrame | None = None, max_epochs: int = 2) -> DataFrame:
    """leaves (levels..., tokens) plus cap and budget, whole tokens; total is at most all caps.

    A leaf's capacity is max_epochs times its tokens, none if a node on its path has weight 0; a
    node's is the sum of its leaves'. From the root down, a node's budget is dealt to its children
    by weight; a child that cannot use its share gives the rest to its siblings (the saturated ones
    are those of least capacity to weight, found by running sums), and what a whole subtree cannot
    use was dealt to its ancestors' siblings one level up. Shares are rounded down; the tokens that
    this leaves over go, one each, to the children with the largest fractions, by name among
    equals. So the whole total is dealt. weights: (level int, name, weight) for nodes by name, 1
    where it has none or a null.
    """
    out = leaves
    for depth, level in enumerate(levels):
        if weights is None:
            out = out.withColumn(f"__w{depth}", F.lit(1.0))
        else:
            named = weights.where(F.col("level") == depth).select(F.col("name").alias(level), F.col("weight").cast("double").alias(f"__w{depth}"))
            out = out.join(F.broadcast(named) if fits_broadcast(named, 100_000) else named, level, "left").withColumn(f"__w{depth}", F.coalesce(f"__w{depth}", F.lit(1.0)))
    usable = F.lit(True)
    for depth in range(len(levels)):
        usable = usable & (F.col(f"__w{depth}") > 0)
    out = out.withColumn("cap", F.when(usable, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    total = min(total, out.agg(F.sum("cap")).first()[0] or 0)
    out = out.withColumn("budget", F.lit(total).cast("long"))
    for depth, level in enumerate(levels):
        path, parent = list(levels[: depth + 1]), list(levels[:depth])
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("node_cap"), F.min("budget").alias("given"), F.min(f"__w{depth}").alias("w"))
        by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        ratio = F.when(F.col("w") > 0, F.col("node_cap") / F.col("w")).otherwise(F.lit(float("inf")))
        order = by.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
        nodes = (
            nodes.withColumn("ratio", ratio)
            .withColumn("cap_before", F.coalesce(F.sum("node_cap").over(order), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
            .withColumn("left", F.col("given") - F.col("cap_before"))
            .withColumn("full", (F.col("w") > 0) & (F.col("node_cap") * F.col("w_left") <= F.col("left") * F.col("w")))
        )
        # Saturated children come first; the first that is not fixes the share of all others.
        first = F.min(F.when(~F.col("full"), F.struct("ratio", level, "left", "w_left"))).over(by)
        nodes = nodes.withColumn("cut", first)
        before = F.col("cut").isNull() | (F.struct("ratio", level) < F.struct(F.col("cut.ratio"), F.col(f"cut.{level}")))
        nodes = nodes.withColumn("open", ~before & (F.col("w") > 0)).withColumn("exact", F.when(F.col("open"), F.col("cut.left") * F.col("w") / F.col("cut.w_left")))
        nodes = nodes.withColumn("share", F.floor("exact").cast("long"))
        nodes = nodes.withColumn("over", F.col("cut.left") - F.sum("share").over(by))
        nodes = nodes.withColumn("place", F.row_number().over(by.orderBy(F.desc("open"), F.desc(F.col("exact") - F.col("share")), level)))
        one = F.when(F.col("place") <= F.col("over"), F.lit(1)).otherwise(F.lit(0))
        budget = F.when(before, F.col("node_cap")).when(F.col("open"), F.col("share") + one).otherwise(F.lit(0)).cast("long")
        out = out.drop("budget").join(nodes.select(*path, budget.alias("budget")), path)
    return out.drop(*(f"__w{d}" for d in range(len(levels))))


def plan(
    docs: DataFrame,
    fraction: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    weights: DataFrame | None = None,
    buckets_hex: int = 3,
    fine_rows: int = 1 << 20,
) -> DataFrame:
    """A row for each leaf: its whole epochs, and where its prefix of the next epoch ends.

    Budget: fraction of all tokens. A leaf takes whole seeded epochs while its budget lasts, then
    the longest prefix, in the next epoch's order, whose tokens fit. The end is found in steps, so
    no leaf is ever in one task: tokens are summed by leaf and 16^buckets_hex ranges of the order;
    the range in which the budget ends is divided again while it has over fine_rows rows, and only
    what is left is ordered row by row. A table of few leaves (counted) is broadcast, a larger one
    is joined by shuffle, with the same result.
    """
    keys = list(LEVELS)
    rows = materialize(tree(docs).select("doc_id", *keys, "__tokens"), "mix-rows")
    leaves = materialize(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")), "mix-leaves")
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    dealt = budgets(leaves, min(int(everything * fraction), max_epochs * everything), LEVELS, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    dealt = dealt.withColumn("whole", whole).select(*keys, "budget", "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("remain"))
    dealt = materialize(dealt, "mix-budgets")
    hint = F.broadcast if fits_broadcast(dealt, 100_000) else lambda x: x
    placed = rows.join(hint(dealt), keys).withColumn("rank", _rank(seed, F.col("whole"), F.col("doc_id"))).select("rank", *keys, "__tokens")
    edge, depth, most = dealt.select(*keys, F.lit("").alias("edge"), F.col("remain").alias("room")), 0, fine_rows + 1
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    while depth == 0 or (most > fine_rows and depth < 32):
        depth += buckets_hex
        inside = placed.join(hint(edge), keys).where(F.substring("rank", F.lit(1), F.length("edge")) == F.col("edge"))
        sums = inside.groupBy(*keys, "room", F.substring("rank", 1, depth).alias("bucket")).agg(F.sum("__tokens").alias("t"), F.count("*").alias("n"))
        ends = (
            sums.withColumn("before", F.coalesce(F.sum("t").over(order), F.lit(0)))
            .where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("t") > F.col("room")))
            .select(*keys, F.col("bucket").alias("edge"), (F.col("room") - F.col("before")).alias("room"), "n")
        )
        edge = materialize(ends, "mix-edges")  # at most a row for each leaf
        most = edge.agg(F.max("n")).first()[0] or 0
    # Rows of one rank (one doc_id repeated) are taken together or left together.
    upto = Window.partitionBy(*keys).orderBy("rank")
    fine = placed.join(hint(edge), keys).where(F.substring("rank", 1, depth) == F.col("edge")).withColumn("sum", F.sum("__tokens").over(upto))
    cut = fine.where("sum <= room").groupBy(*keys).agg(F.max("rank").alias("cut"))
    out = dealt.join(edge.select(*keys, "edge"), keys, "left").join(cut, keys, "left")
    return materialize(out.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("budget", "whole", "remain", "edge", "cut"))), "mix-plan")


def mix(docs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """docs' rows that the plan takes, with __domain, __lang, __source, __tokens and epoch (from 0).

    A row taken in several epochs comes once for each. A leaf without tokens gives no row; rows
    without tokens elsewhere are taken where the order puts them. A column of docs called epoch is
    replaced, other columns are kept whatever their names, but for names with two leading
    underscores, which the operator uses. The plan has a row for each leaf; it is broadcast if
    counted to be small, so texts are not shuffled. An empty table gives an empty result.
    """
    keys, small = list(LEVELS), fits_broadcast(plan, 100_000)
    rows = tree(docs).join(F.broadcast(plan) if small else plan, keys)
    rows = rows.withColumn("__rank", _rank(seed, F.col("__whole"), F.col("doc_id")))
    before = F.substring("__rank", F.lit(1), F.length("__edge")) < F.col("__edge")
    head = F.col("__edge").isNotNull() & (before | F.coalesce(F.col("__rank") <= F.col("__cut"), F.lit(False)))
    times = F.col("__whole") + head.cast("int")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return rows.select(*(c for c in docs.columns if c != "epoch"), *keys, "__tokens", "epoch")
