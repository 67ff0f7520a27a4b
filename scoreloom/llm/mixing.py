"""Mixing sources to target weights in a domain-language-source tree.

The token budget goes from the root down: the children of a node share its budget by weight,
and a child that has too few tokens leaves the rest to its siblings, by weight again. A node
never gets more than its leaves hold, so a shortage leaves a subtree only when the whole
subtree is used up. A leaf takes its documents in the seeded order of epoch 0, then of epoch
1, and so on, up to the document that would pass its budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import settled
from scoreloom.operators.numbering import number_rows

LEVELS = ("domain", "lang", "source")
SEED = 7
MAX_EPOCHS = 2
# Of all tokens there are.
BUDGET = 1.0
# Rows of a leaf in one bucket of its seeded order, on average.
PER_BUCKET = 4096
# Leaf tables up to this many rows are sent to every task.
SMALL = 10_000

WORD = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """Five sources by number make a domain; without a number it is 'other'."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.floor(number.cast("int") / 5).cast("string")))


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budget of every child from its parent's `given`, filled in order of tokens held per weight."""
    among = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = among.orderBy((F.col("held") / F.col("weight")), *LEVELS[: len(parent) + 1])
    so_far = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.rowsBetween(0, Window.unboundedFollowing)
    told = nodes.withColumn("full", F.coalesce(F.sum("held").over(so_far), F.lit(0))).withColumn(
        "open", F.sum("weight").over(rest)
    )
    # A child is used up whole if those before it are and its own share at this level covers it.
    told = told.withColumn(
        "level", F.greatest(F.lit(0), F.col("given") - F.col("full")) / F.col("open")
    ).withColumn("whole", F.col("held") <= F.col("level") * F.col("weight"))
    level = F.coalesce(F.min(F.when(~F.col("whole"), F.struct("full", "open", "level"))).over(among)["level"], F.lit(0.0))
    return told.withColumn(
        "budget", F.when(F.col("whole"), F.col("held").cast("double")).otherwise(level * F.col("weight"))
    ).drop("full", "open", "level", "whole")


def budgets(leaves: DataFrame, weights: Mapping[str, float], total: int, max_epochs: int) -> DataFrame:
    """Leaves with a `budget` in whole tokens; leaves have the levels and `tokens`.

    weights are looked up by a node's name on its own level; the default is 1.
    """
    named = F.create_map(*(F.lit(x) for pair in (weights or {"": 1.0}).items() for x in pair))
    held = leaves.withColumn("held", F.col("tokens") * max_epochs)
    most = held.agg(F.sum("held")).first()[0] or 0
    above, path = None, []
    for level in LEVELS:
        nodes = held.groupBy(*path, level).agg(F.sum("held").alias("held"))
        nodes = nodes.join(above, path) if path else nodes.withColumn("given", F.lit(float(min(most, total))))
        nodes = nodes.withColumn("weight", F.coalesce(named[F.col(level)].cast("double"), F.lit(1.0)))
        shared = _share(nodes, path)
        path = [*path, level]
        above = shared.select(*path, F.col("budget").alias("given"))
    # A hair above, so that a budget that is a whole number stays one.
    return leaves.join(above, path).withColumn("budget", F.floor(F.col("given") + 1e-6)).drop("given")


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the mix needs of each document; `mark` is its text's xxhash64."""
    return settled(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            domain_of(F.col("source")).alias("domain"),
            _named("lang").alias("lang"),
            _named("source").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
            F.xxhash64(F.col(text_col).cast("binary")).alias("mark"),
        )
    )


def select_mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each time a document is taken: doc_id, domain, lang, source, n_tokens, epoch, leaf_budget.

    Tokens are words. A null text has none; a null language or source is 'none'. Rows without
    id are ordered as if their id were empty, rows with equal ids by tokens. A leaf without
    tokens gives all its documents once if it gets any turn, that is always. An empty table
    gives no rows. No leaf is ordered whole: its seeded order is cut into buckets whose tokens
    are summed first, and only the bucket in which the budget ends is looked at row by row.
    """
    return _taken(_rows(docs, id_col, text_col), weights, budget, max_epochs, seed).drop("mark")


def _taken(rows: DataFrame, weights: Mapping[str, float], budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    path = list(LEVELS)
    leaves = rows.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    leaves = settled(leaves)
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget)
    plan = budgets(leaves, weights, total, max_epochs)
    plan = settled(
        plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        .withColumn("buckets", F.ceil(F.col("n_rows") / PER_BUCKET))
    )
    small = plan.count() <= SMALL
    send = F.broadcast if small else (lambda df: df)
    placed = rows.join(send(plan.select(*path, "epochs", "rest", "buckets", "budget")), path)
    order = F.md5(
        F.concat_ws("/", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    )
    part = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(1 << 32))
    placed = placed.withColumn("order", order).withColumn("bucket", F.floor(part))
    # Tokens by bucket, and for each leaf the bucket in which its rest ends.
    sums = placed.groupBy(*path, "rest", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    in_order = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("upto", F.sum("tokens").over(in_order))
        .where("upto > rest")
        .groupBy(*path)
        .agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("end"))
    )
    placed = placed.join(send(ends), path, "left")
    taken = ["doc_id", *path, "n_tokens", "mark"]
    whole = placed.where("epochs > 0").select(
        *taken, F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), F.col("budget").alias("leaf_budget")
    )
    next_one = placed.where(F.col("rest") > 0)
    before = next_one.where("end IS NULL OR bucket < end.bucket")
    running = Window.partitionBy(*path).orderBy("order", "doc_id", "n_tokens", "mark").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        next_one.where("bucket = end.bucket")
        .withColumn("upto", F.sum("n_tokens").over(running))
        .where("upto <= end.left")
    )
    parts = [df.select(*taken, F.col("epochs").alias("epoch"), F.col("budget").alias("leaf_budget")) for df in (before, last)]
    return whole.unionByName(parts[0]).unionByName(parts[1])


def mixed(
    docs: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents as often as they are taken, with all their columns.

    Rows are told apart by id, language, source and text. Of rows alike in all four, taken some
    times together, each is taken as often as the next, or once more.
    """
    keys = ["doc_id", "lang", "source", "mark"]
    rows = _rows(docs, id_col, text_col)
    times = _taken(rows, weights, **options).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    told = settled(
        times.alias("a").join(copies.alias("b"), same).select(
            *(F.col(f"a.{k}").alias(f"__{k}") for k in keys),
            F.expr("times DIV copies").alias("__times"),
            F.expr("times % copies").alias("__more"),
        )
    )
    own = {
        "doc_id": docs[id_col].cast("long"),
        "lang": F.coalesce(docs["lang"].cast("string"), F.lit("none")),
        "source": F.coalesce(docs["source"].cast("string"), F.lit("none")),
        "mark": F.xxhash64(docs[text_col].cast("binary")),
    }
    found = docs.join(told, [own[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    if told.where("__more > 0").isEmpty():
        turns = found.where("__times > 0")
    else:
        # Which of the rows that are alike get one more turn does not matter, only how many.
        alike = F.concat_ws("/", *(F.coalesce(F.col(f"__{k}").cast("string"), F.lit("")) for k in keys))
        some = found.where("__more > 0").withColumns({"__alike": alike, "__at": F.monotonically_increasing_id()})
        placed = number_rows(some, ["__alike"], ["__at"], "__place")
        more = placed.withColumn("__times", F.col("__times") + (F.col("__place") <= F.col("__more")).cast("long"))
        turns = found.where("__more = 0").unionByName(more.drop("__alike", "__at", "__place")).where("__times > 0")
    repeated = turns.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return repeated.select(*docs.columns)
