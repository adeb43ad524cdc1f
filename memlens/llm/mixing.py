"""Mixing sources to target weights by hierarchical budgets.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_HEX = 3
SALTS = 64


def n_tokens(text: Column) -> Column:
    """Words of the text, at least 1: every row costs something, empty ones too."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def uniform_weights(leaves: DataFrame) -> DataFrame:
    return leaves.select(*LEVELS, F.lit(1.0).alias("weight"))


def _share(children: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none above its ``capacity``.

    Children in order of capacity per weight: one is full when that ratio is at most (budget left after the fuller
    ones) / (weight left).  What the full ones cannot take goes to their siblings by weight, and a parent gives back
    to its own siblings only what no child can take, because its capacity is the sum below it.
    """
    group = [F.lit(0)] if not parent else [F.col(c) for c in parent]
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = W.partitionBy(*group).orderBy("ratio", name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    left = F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double")
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("budget") - left) / F.when(weight_left > 1e-12, weight_left)
    rows = children.withColumn("ratio", ratio).withColumn("level", level)
    full = (F.col("weight") > 0) & (F.col("ratio") <= F.col("level"))
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    spare = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(whole)
    part = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(
        F.coalesce(F.greatest(spare, F.lit(0.0)) * F.col("weight") / F.when(open_weight > 1e-12, open_weight), F.lit(0.0)))
    return rows.withColumn("budget", F.least(part, F.col("capacity").cast("double"))).drop("ratio", "level", "full")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget: float, share: bool, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf.

    ``leaves`` has the tokens of each leaf; ``weights`` a weight per leaf (absent: 0), and a node's weight is the sum
    below it.  ``budget`` is in tokens, or a share of all tokens when ``share``.  A leaf can give ``max_epochs``
    times its tokens.  Nulls in the tree's columns are leaves of their own.
    """
    key = lambda df: [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in LEVELS]
    weighted = weights.select(*key(weights), "weight").groupBy(*LEVELS).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"))
    rows = leaves.select(*key(leaves), "tokens").groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).join(weighted, list(LEVELS), "left").select(
        *LEVELS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = rows.withColumn("capacity", F.when(F.col("weight") > 0, F.col("tokens") * max_epochs).otherwise(0))
    total = leaves.agg((F.sum("tokens") * budget if share else F.lit(float(budget))).cast("double").alias("budget"))
    above = total
    for depth, name in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = rows.groupBy(*path).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("budget", above.scalar()) if depth == 0 else nodes.join(above, list(path[:-1]))
        above = _share(nodes, path[:-1], name).select(*path, "budget")
    return rows.join(above, list(LEVELS)).select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, budget: float, share: bool = False, max_epochs: int = 2, seed: int = 0,
        key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: bool = False) -> DataFrame:
    """Rows chosen to match target weights: (key, epoch, tokens, domain, lang, source), one per document and epoch.

    Every leaf of the tree domain > lang > source gets a budget (see ``leaf_budgets``).  Its documents are put in a
    seeded order per epoch; whole epochs are taken while the budget holds, then the prefix of the next epoch whose
    tokens fit.  Tokens are words, 1 at least.  A document is taken whole or not at all, so a leaf ends short of its
    budget by less than one document.  Rows with a null key or repeated keys are rows like any other.
    With ``carry`` each result row also has its own input row, as struct ``_row``: ids cannot tell rows apart.
    Running sums use hash buckets of the order, so a leaf that holds a third of all rows is spread over 16**BUCKET_HEX groups.
    """
    path = [F.coalesce(c.cast("string"), F.lit("\0")) for c in (domain, F.col(lang), F.col(source))]
    rows = docs.select(F.col(key).alias(key), n_tokens(F.col(text)).alias("tokens"), *[c.alias(n) for c, n in zip(path, LEVELS, strict=True)],
                       *([F.struct(*docs.columns).alias("_row")] if carry else []))
    own = ["_row"] if carry else []
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, budget, share, max_epochs).withColumnRenamed("tokens", "leaf_tokens")
    # whole epochs, and what is left for the next one
    budgets = budgets.withColumn("epochs", F.floor(F.col("budget") / F.col("leaf_tokens")).cast("int"))
    budgets = budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens"))
    # a leaf's rows meet its budget in SALTS places, not in one
    salted = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "_salt"])
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epochs").cast("string"), F.col(key).cast("string")))
    placed = placed.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET_HEX))
    partial = placed.where("rest > 0")
    before = W.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = partial.groupBy(*LEVELS, "_bucket").agg(F.sum("tokens").alias("_n"), F.first("rest").alias("_rest")).select(
        *LEVELS, "_bucket", "_n", "_rest", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    heads = heads.where("_base < _rest")
    inner = W.partitionBy(*LEVELS, "_bucket").orderBy("_order", F.col(key).asc_nulls_first(), "tokens", *[F.xxhash64(c) for c in own]).rowsBetween(W.unboundedPreceding, 0)
    prefix = partial.join(heads.select(*LEVELS, "_bucket", "_base"), [*LEVELS, "_bucket"]).withColumn("_sum", F.sum("tokens").over(inner) + F.col("_base"))
    prefix = prefix.where("_sum <= rest").select(key, F.col("epochs").alias("epoch"), "tokens", *LEVELS, *own)
    whole = placed.where("epochs > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), "tokens", *LEVELS, *own)
    null = lambda c: F.when(F.col(c) != "\0", F.col(c)).alias(c)
    return whole.unionAll(prefix).select(key, "epoch", "tokens", *[null(c) for c in LEVELS], *own)


def source_domain(source: Column) -> Column:
    """Domain of the given tables' sources: the last digit of the name, in five groups; no digit: ``d0``."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(digit, F.lit("9")).cast("int"), F.lit(0)) % 5).cast("string"))


def tree_of(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Equal weights for the domains' languages' sources that occur: (domain, lang, source, weight)."""
    return docs.select(source_domain(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source")).distinct().withColumn("weight", F.lit(1.0))
