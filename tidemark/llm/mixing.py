"""Mixing sources to target weights by hierarchical budgeting.

Sources hang in a tree: domain, language, source.  Each inner node shares its token budget among its children in
proportion to their weights, but no child gets more than it can supply (``max_epochs`` passes over its documents).  What
one child cannot supply goes to its siblings first; only what a whole family cannot supply goes to the families beside
it, because a parent's own supply is the sum of its children's.  The shares have a closed form: with children sorted by
supply / weight, the common rate is the largest of (budget - supply before) / (weight from here on), and a child gets
the lesser of its supply and rate x weight.  The tree holds one row per (language, source), never documents.

A leaf is then filled from seeded epochs: whole passes first, and a prefix of one more pass in the order of a seeded
hash.  The prefix is found without sorting a leaf in one task: tokens are summed per slice of the hash range, running
sums over blocks of slices and over the slices of a block settle all slices but one, and only that slice's documents are
ranked.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, unused, written

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixPlan:
    """Weights by name at each level of the tree; what is not named has weight 1."""

    domains: Mapping[str, int] = field(default_factory=dict)
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    #: Token budget as a share of the tokens there are: budget_num / budget_den.
    budget_num: int = 3
    budget_den: int = 5
    max_epochs: int = 2
    seed: int = 17
    #: The hash range of a leaf is cut into 2 ** slice_bits slices.
    slice_bits: int = 12


#: The production plan over the documents table.
PLAN = MixPlan(
    domains={"web": 4, "reference": 3, "news": 2, "forum": 1},
    languages={"en": 6, "de": 2, "fr": 2, "es": 1},
)


def source_domain(source: Column) -> Column:
    """Domain of a source by the number that ends its name; anything else is a forum."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return F.when(n < 5, "web").when(n < 10, "reference").when(n < 15, "news").otherwise("forum")


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    value: Column | None = None
    for name, weight in weights.items():
        value = F.when(F.col(column) == name, weight) if value is None else value.when(F.col(column) == name, weight)
    return (F.lit(1) if value is None else value.otherwise(1)).cast("double")


def _share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Adds ``alloc`` to rows with (supply, weight): the budget of their parent shared out with supplies as caps."""
    # a family is as large as the tree is wide, whatever the number of documents
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), "node")
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rated = nodes.withColumn("rate", (budget - before) / onward)
    return rated.withColumn("alloc", F.least("supply", F.max("rate").over(Window.partitionBy(*parent)) * F.col("weight"))).drop("rate")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """(domain, lang, source, avail) with the whole tokens each leaf shall give as ``target``."""
    leaves = leaves.withColumn("supply", (F.col("avail") * plan.max_epochs).cast("double"))
    top = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("avail").alias("avail"))
    budget = F.floor(F.sum("avail").over(Window.partitionBy(F.lit(0))) * plan.budget_num / plan.budget_den).cast("double")
    top = top.withColumn("budget", budget).withColumn("weight", _weight("domain", plan.domains)).withColumn("node", F.col("domain")).withColumn("all", F.lit(0))
    top = _share(top, ["all"], F.col("budget")).select("domain", F.col("alloc").alias("budget"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(top, "domain")
    mid = mid.withColumn("weight", _weight("lang", plan.languages)).withColumn("node", F.col("lang"))
    mid = _share(mid, ["domain"], F.col("budget")).select("domain", "lang", F.col("alloc").alias("budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("weight", _weight("source", plan.sources)).withColumn("node", F.col("source"))
    return _share(low, ["domain", "lang"], F.col("budget")).select(*LEAF, "avail", F.floor("alloc").cast("long").alias("target"))


def epoch_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits that order a document within a seeded epoch."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(df: DataFrame, plan: MixPlan = PLAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens, target (tokens of its leaf), copies.

    Tokens are words.  Null lang and source are leaves of their own, named "".  Texts without words cost nothing and go
    with their place in the order of a pass that is begun; where no token is left for a further pass, none is begun, so
    that no document is taken more than ``max_epochs`` times.  Repeated rows of an id in a leaf stand at one place and are
    taken together.  Very long texts count whole.  An empty table gives an empty result; other columns are not read.
    """
    docs = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            source_domain(F.col("source")).alias("domain"),
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        )
    )
    leaves = docs.groupBy(*LEAF).agg(F.sum("n_tokens").alias("avail"))
    whole = F.when(F.col("avail") > 0, F.expr("target div avail")).otherwise(F.lit(0).cast("long"))
    budgets = written(leaf_budgets(leaves, plan).withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("avail")))
    placed = docs.join(budgets, list(LEAF)).withColumn("h", epoch_hash(plan.seed, F.col("epochs"), F.col("doc_id")))
    placed = written(placed.withColumn("slice", F.shiftright("h", 60 - plan.slice_bits)))
    slices = placed.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("in_slice"), F.first("rest").alias("rest"))
    half = plan.slice_bits // 2
    slices = written(slices.withColumn("block", F.shiftright("slice", half)))
    run_of = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = slices.groupBy(*LEAF, "block").agg(F.sum("in_slice").alias("in_block"))
    blocks = blocks.withColumn("ahead", F.sum("in_block").over(run_of(LEAF, "block")) - F.col("in_block")).drop("in_block")
    slices = slices.withColumn("within", F.sum("in_slice").over(run_of((*LEAF, "block"), "slice"))).join(blocks, [*LEAF, "block"])
    slices = slices.withColumn("upto", F.col("ahead") + F.col("within")).withColumn("before", F.col("upto") - F.col("in_slice"))
    # all slices that end within the rest are taken; the one that the rest ends in is ranked; no rest, no further pass
    slices = slices.where("rest > 0 AND before <= rest").select(*LEAF, "slice", "before", (F.col("upto") <= F.col("rest")).alias("inside"))
    found = placed.join(slices, [*LEAF, "slice"], "left")
    inside = F.coalesce("inside", F.lit(False))
    edge = (F.col("before").isNotNull()) & ~inside
    order = Window.partitionBy(*LEAF, "slice").orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.where(edge).withColumn("extra", (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("long"))
    settled = found.where(~edge).withColumn("extra", inside.cast("long"))
    return settled.unionByName(ranked).select("doc_id", *LEAF, "n_tokens", "target", (F.col("epochs") + F.col("extra")).alias("copies"))


def draw(df: DataFrame, plan: MixPlan = PLAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` as often as the plan takes them, with their own columns.

    Rows that repeat an id in one leaf are drawn alike; in other leaves the id has a number of its own.  Null ids are one
    id.  A very long text counts by its length like any other.  An empty table gives an empty result; clashing columns do
    no harm.
    """
    own, times, copy = unused(df, "__id"), unused(df, "__copies"), unused(df, "__copy")
    lang, source = unused(df, "__lang"), unused(df, "__source")
    taken = mix(df, plan, id_col, text_col).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias(own), F.col("lang").alias(lang), F.col("source").alias(source)).agg(F.max("copies").alias(times))
    same = df[id_col].eqNullSafe(taken[own]) & (F.coalesce(df["lang"], F.lit("")) == taken[lang]) & (F.coalesce(df["source"], F.lit("")) == taken[source])
    return df.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*(df[c] for c in df.columns))
