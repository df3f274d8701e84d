"""Mixing sources to target weights: token budgets flow down a tree of columns
(such as domain, language, source), and each leaf gives a token-prefix of its
documents in a seeded order, epoch by epoch.

A node shares its budget among its children by weight. A child that cannot
take its share (its tokens times ``max_epochs``) is filled, and what is left goes
to its siblings by weight; only when all of them are full does the parent pass
less on, and then its own siblings take it: shortages stay as low in the tree
as they can. Children are few beside documents, so this runs on the small
table of nodes; documents meet it through one row per leaf.

A leaf with budget b and s tokens is used floor(b / s) times whole; from the next
epoch's order it gives the longest prefix within what is left of b. The order
of epoch e is by md5 of (seed, e, key), so a prefix is a cut-off in that hash:
slots of leading hex digits are summed first, and only the slot that holds
the cut is sorted. No task sees a whole leaf.

Nulls: a null in a level is a value of its own; a null key orders by its text
'null'; a null text has no tokens and comes with any prefix that reaches it.
Rows with equal keys go together. An empty table, or a budget of 0, gives leaves
without documents. A node without a weight has weight 1; weight 0 excludes it. Texts
of any length are counted whole. Columns of any name go along unchanged; helper
columns take names that the rows do not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwise.session import materialize

SLOT_DIGITS = 3
BROADCAST_LEAVES = 100_000  # leaves up to which their table is broadcast (about 100 bytes each)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(key: str, seed: int, epoch: Column) -> Column:
    """The hash that orders documents in an epoch."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[f"_{n}"])
    return on


def _join(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``names``, kept once."""
    if not names:
        return a.crossJoin(F.broadcast(b))  # b has one row
    b = b.withColumnsRenamed({n: f"_{n}" for n in names})
    return a.join(b, _same(a, b, names), how).drop(*(f"_{n}" for n in names))


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children (cap, weight, and their parent's ``given``)."""
    ratio = F.col("cap") / F.col("weight")
    up = Window.partitionBy(*parents).orderBy(ratio, name)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("level", (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                            / (F.sum("weight").over(Window.partitionBy(*parents)) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    open_level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy(*parents))
    return rows.withColumn("budget", F.when(full, F.col("cap").cast("double")).otherwise(F.greatest(F.lit(0.0), open_level) * F.col("weight"))).drop("level", "given")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: DataFrame,
                 max_epochs: int) -> DataFrame:
    """``leaves``: levels and ``tokens``. ``weights[level][value]``: whole numbers.
    ``budget``: one row with ``given``. Adds ``budget`` (whole tokens) per leaf."""
    w = {}
    for n in levels:
        pick = F.lit(1)
        for value, number in weights.get(n, {}).items():
            pick = F.when(F.col(n).eqNullSafe(F.lit(value)), F.lit(int(number))).otherwise(pick)
        w[n] = pick.cast("long")
    kept = leaves
    for n in levels:
        kept = kept.where(w[n] > 0)
    kept = kept.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    given = budget.select(F.col("given").cast("double").alias("given"))
    for i, n in enumerate(levels):
        nodes = kept.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", w[n])
        nodes = _share(_join(nodes, given, levels[:i]), levels[:i], n)
        given = nodes.select(*levels[: i + 1], F.col("budget").alias("given"))
    shares = given.select(*levels, F.floor("given").cast("long").alias("budget"))
    return _join(leaves, shares, levels, "left").fillna({"budget": 0})


def free(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of ``frames`` has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plan_mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float | None = None,
             tokens: int | None = None, max_epochs: int = 4, seed: int = 1, key: str = "doc_id",
             text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: key, levels, n_tokens; leaves: level0, level1, ... in the order of
    ``levels``, tokens, budget, whole epochs, and the cut of the next one, null if
    nothing more is taken). The budget is ``tokens``, or ``share`` of all tokens.
    Tokens are words. Levels may have any names but those of the key and n_tokens."""
    own = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(F.col(key).alias("_key"), *[F.col(n).alias(o) for n, o in zip(levels, own)], n_words(text).alias("n_tokens"))
    small, plan = _plan(rows, own, {o: weights.get(n, {}) for n, o in zip(levels, own)}, share, tokens, max_epochs, seed)
    return small.select(F.col("_key").alias(key), *[F.col(o).alias(n) for n, o in zip(levels, own)], "n_tokens"), plan


def _plan(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float | None, tokens: int | None,
          max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    small = materialize(rows)
    leaves = small.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    budget = total.select((F.lit(tokens) if tokens is not None else F.floor(F.col("all") * F.lit(share))).alias("given"))
    plan = leaf_budgets(leaves, levels, weights, budget, max_epochs)
    times = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", times.cast("long")).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = materialize(plan)
    # rows of the epoch that is cut, by key; equal keys together
    keyed = _meet(small, plan.where(F.col("left") > 0), levels).withColumn("k", order_key("_key", seed, F.col("epochs")))
    keyed = materialize(keyed.groupBy(*levels, "left", "k").agg(F.sum("n_tokens").alias("n")))
    slot = F.substring("k", 1, SLOT_DIGITS).alias("slot")
    slots = keyed.groupBy(*levels, "left", slot).agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*levels).orderBy("slot")
    slots = slots.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    cut = slots.where((F.col("upto") > F.col("left")) & (F.col("before") <= F.col("left")))
    cut = cut.groupBy(*levels).agg(F.min(F.struct("slot", "before")).alias("s")).select(*levels, "s.slot", "s.before")
    one = keyed.withColumn("slot", slot)
    one = _join(one, cut.withColumnsRenamed({"slot": "at"}), levels).where(F.col("slot") == F.col("at"))
    inside = one.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*levels).orderBy("k")))
    last = inside.where(F.col("upto") <= F.col("left")).groupBy(*levels).agg(F.max("k").alias("last"))
    ends = _join(_join(plan, cut.select(*levels, "slot"), levels, "left"), last, levels, "left")
    # up to the last key that fits in the cut slot, or else all earlier slots; without a cut slot all of the epoch
    reach = F.when(F.col("left") <= 0, F.lit(None)).when(F.col("slot").isNull(), F.lit("g")).otherwise(F.coalesce("last", "slot"))
    return small, ends.select(*levels, "tokens", "budget", "epochs", reach.alias("cut"))


def _meet(rows: DataFrame, plan: DataFrame, levels: list[str]) -> DataFrame:
    few = plan.count() <= BROADCAST_LEAVES  # one row per leaf
    return _join(rows, F.broadcast(plan) if few else plan, levels)


def select_mix(rows: DataFrame, plan: DataFrame, levels: list[str], seed: int = 1, key: str = "doc_id", epoch: str = "epoch") -> DataFrame:
    """The rows of each epoch that the plan takes, with all their columns and the
    epoch (from 0) in a new column, whose name ``rows`` must not have yet."""
    if epoch.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {epoch} already")
    names = {c: free(f"_{c}", rows) for c in ("epochs", "cut")} | {f"level{i}": free(f"_level{i}", rows) for i in range(len(levels))}
    leaves = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    leaves = F.broadcast(leaves) if plan.count() <= BROADCAST_LEAVES else leaves  # one row per leaf
    on = F.lit(True)
    for i, n in enumerate(levels):
        on = on & F.col(n).eqNullSafe(F.col(names[f"level{i}"]))
    met = rows.join(leaves, on)
    met = met.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(names["epochs"]))))
    whole = F.col(epoch) < F.col(names["epochs"])
    return met.where(whole | (order_key(key, seed, F.col(epoch)) <= F.col(names["cut"]))).select(*rows.columns, epoch)
