"""Mixing sources to target shares of the total size.

Method: hierarchical budgeting. The target weights are propagated down a tree of
domain, language and source; what a branch can't supply is redistributed among
its siblings before its ancestors; each leaf's budget then takes a prefix of
seeded epochs, each a permutation of the leaf's documents: whole epochs first,
then the documents of the next one until the budget is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.text import stripped
from strandlake.session import local_frame, materialize

#: Documents of a leaf are cut by their hash into buckets of about this many, so that no leaf is sorted in one task.
DOCS_PER_BUCKET = 100_000


@dataclass(frozen=True)
class Leaf:
    """A source in one language. ``path``: domain, language, source; ``weight``: target; ``size``: one use; ``most``: all uses allowed."""

    path: tuple[str, ...]
    weight: float
    size: int
    most: int


@dataclass(frozen=True)
class Mix:
    """``uses``: documents with their number of uses (1 or more). ``leaves``, ``shares``: limits, budgets and what was taken, per leaf and per target."""

    uses: DataFrame
    leaves: DataFrame
    shares: DataFrame


def language(lang: Column) -> Column:
    """Two-letter language of a tag in any case; 'und' where it gives none. At most 26 * 26 + 1 values."""
    tag = F.regexp_extract(F.lower(stripped(lang)), r"^([a-z]{2})(?:[a-z]?$|[-_])", 1)
    return F.when(F.coalesce(tag, F.lit("")).isin("", "un"), "und").otherwise(tag)


def distribute(budget: float, weights: list[float], most: list[float]) -> list[float]:
    """Shares of a budget in proportion to weights, none over its limit; a shortage goes to the others by weight."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    while open_ and budget > 1e-9:
        unit = budget / sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + weights[i] * unit >= most[i]]
        if not full:
            for i in open_:
                out[i] += weights[i] * unit
            break
        for i in full:
            budget -= most[i] - out[i]
            out[i] = most[i]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(leaves: list[Leaf], total: float) -> dict[tuple[str, ...], int]:
    """Each leaf's budget. Limits are summed up the tree first, so a branch gets what it can supply and no more."""

    def down(nodes: list[Leaf], depth: int, budget: float) -> dict[tuple[str, ...], float]:
        if len(nodes) == 1 and depth == len(nodes[0].path):
            return {nodes[0].path: min(budget, nodes[0].most)}
        names = sorted({n.path[depth] for n in nodes})
        groups = [[n for n in nodes if n.path[depth] == name] for name in names]
        given = distribute(budget, [sum(n.weight for n in g) for g in groups], [sum(n.most for n in g if n.weight > 0) for g in groups])
        return {k: v for g, b in zip(groups, given) for k, v in down(g, depth + 1, b).items()}

    return {k: int(v + 1e-6) for k, v in down(leaves, 0, total).items()} if leaves else {}


LEAF = ["domain", "lang", "source"]


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, lang: str, size: Column, seed: int = 7, domain: Column | None = None) -> Mix:
    """Choose documents so that each source of ``targets`` gives its share of the mix.

    ``targets``: ``source``, ``target_share``, ``max_uses``; one row per source,
    a small fixed table. Sources of ``docs`` are stripped and compared in lower
    case; those not among the targets, and null, aren't used. ``domain``: the
    top of the tree, an expression of few values; null is a domain of its own
    (default: one domain for all). The mix is as large as all documents of the
    targets' sources counted once, where the limits allow it.

    ``uses``: ``key``, ``source``, ``size``, ``n_uses``. ``leaves``, one row per
    domain, language and source: ``available`` (size of its documents, each
    once), ``most`` (all uses allowed), ``budget``, ``taken``. ``shares``, one
    row per target: ``source``, ``target_share``, ``max_uses``, ``available``,
    ``budget``, ``taken``, ``share`` of the mix (0 for an empty mix) and
    ``reachable``: false where the mix takes every allowed use and the target
    isn't met.

    A null size counts as 0. Repeated rows are documents of their own. Null or
    negative shares and uses count as 0. A leaf's prefix ends where it is
    nearest to the budget, off by half a document at most. Which documents are
    chosen depends on ``seed`` and the keys alone, but for documents without a
    key, which are told apart by their row.
    """
    spark = docs.sparkSession
    goals = {}
    for r in targets.select("source", "target_share", "max_uses").collect():
        if r["source"] is not None:
            goals[r["source"].strip().lower()] = (r["source"], max(r["target_share"] or 0.0, 0.0), max(r["max_uses"] or 0, 0))
    top = F.lit("all") if domain is None else F.coalesce(domain.cast("string"), F.lit(""))
    own = F.lower(stripped(F.col(f"`{source}`")))
    named = docs.where(own.isin(*goals)).select(
        F.col(f"`{key}`").alias("_key"), top.alias("domain"), language(F.col(f"`{lang}`")).alias("lang"), own.alias("source"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_size"), F.monotonically_increasing_id().alias("_row"),
    )
    sized = materialize(named, "sized")  # texts are measured once

    # bounded: domains times languages times targets
    found = {tuple(r[c] for c in LEAF): (int(r["s"]), r["n"]) for r in sized.groupBy(*LEAF).agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()}
    of_source = {s: sum(v[0] for k, v in found.items() if k[2] == s) for s in goals}
    total = sum(of_source.values())
    of_branch = {b: sum(v[0] for k, v in found.items() if k[:2] == b) for b in {k[:2] for k in found}}
    leaves = []
    for s, (_, share, uses) in goals.items():
        for b in sorted(of_branch):
            have = found.get((*b, s), (0, 0))[0]
            # a source without documents weighs on the branches as the whole corpus does
            part = have / of_source[s] if of_source[s] else of_branch[b] / total if total else 0.0
            leaves.append(Leaf((*b, s), share * part, have, have * uses))
    given = budgets(leaves, total)

    plan = []
    for leaf in leaves:
        b, limit = given.get(leaf.path, 0), goals[leaf.path[2]][2]
        epochs = min(b // leaf.size, limit) if leaf.size else 0
        plan.append((*leaf.path, leaf.size, leaf.most, b, epochs, b - epochs * leaf.size if epochs < limit else 0))
    uses = _prefixes(sized, {p[:3]: p[6:] for p in plan}, seed, max((v[1] for v in found.values()), default=0))
    planned = local_frame(spark, [p[:6] for p in plan], "domain string, lang string, source string, available long, most long, budget long")
    per_leaf = uses.groupBy(*LEAF).agg(F.sum(F.col("_size") * F.col("n_uses")).alias("taken"))
    # one row per leaf on either side
    reached = planned.join(F.broadcast(per_leaf), LEAF, "left").select(*LEAF, "available", "most", "budget", F.coalesce("taken", F.lit(0)).alias("taken"))
    facts = [(s, name, share, uses_, share * total) for s, (name, share, uses_) in goals.items()]
    goal = local_frame(spark, facts, "_s string, _name string, target_share double, max_uses int, _goal double")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("available", "most", "budget", "taken")]
    shares = goal.join(F.broadcast(reached), F.col("_s") == F.col("source"), "left").groupBy("_s", "_name", "target_share", "max_uses", "_goal").agg(*sums)
    shares = shares.withColumn("_all", F.sum("taken").over(Window.partitionBy(F.lit(1))))
    short = (F.col("taken") >= F.col("most")) & (F.col("taken") < F.col("_goal"))
    shares = shares.select(F.col("_name").alias("source"), "target_share", "max_uses", "available", "budget", "taken", F.coalesce(F.try_divide("taken", "_all"), F.lit(0.0)).alias("share"), (~short).alias("reachable"))
    return Mix(uses.select(F.col("_key").alias(key), "source", F.col("_size").alias("size"), "n_uses"), reached, shares)


def _prefixes(sized: DataFrame, plan: dict[tuple[str, ...], tuple[int, int]], seed: int, most: int) -> DataFrame:
    """Rows of ``sized`` with ``n_uses``: the whole epochs of their leaf, and one more up to the rest of its budget in the order of the next epoch.

    ``plan``: whole epochs and rest of each leaf. ``most``: rows of the largest
    leaf. Hashes cut a leaf into buckets; only the bucket in which its prefix
    ends is sorted. Where it ends is one row per leaf, which the driver takes.
    """
    spark = sized.sparkSession
    who = F.when(F.col("_key").isNull(), F.xxhash64("_row")).otherwise(F.xxhash64("_key"))
    leaves = local_frame(spark, [(*k, *v) for k, v in plan.items()], "domain string, lang string, source string, _epochs int, _rest long")
    width = (1 << 64) // (16 + most // DOCS_PER_BUCKET) + 1

    def place(leaves: DataFrame) -> DataFrame:
        placed = sized.join(F.broadcast(leaves), LEAF).withColumn("_at", F.xxhash64(F.lit(seed), F.col("_epochs"), who))
        return placed.withColumn("_bucket", F.floor((F.col("_at").cast("double") + F.lit(float(1 << 63))) / F.lit(float(width))).cast("int"))

    sums = place(leaves.where("_rest > 0")).groupBy(*LEAF, "_bucket", "_rest").agg(F.sum("_size").alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = {tuple(r[:3]): r[3:] for r in sums.withColumn("_base", base).where("_base < _rest and _base + _sum >= _rest").select(*LEAF, "_bucket", "_base").collect()}
    known = "domain string, lang string, source string, _epochs int, _rest long, _edge int, _base long"
    leaves = local_frame(spark, [(*k, *v, *edges.get(k, (None, None))) for k, v in plan.items()], known)
    upto = F.col("_base") + F.sum("_size").over(Window.partitionBy(*LEAF).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0))
    inside = place(leaves).where("_bucket = _edge").withColumn("_upto", upto).where(F.col("_upto") - F.col("_size") / 2 <= F.col("_rest"))
    cuts = {tuple(r[:3]): tuple(r[3]) for r in inside.groupBy(*LEAF).agg(F.max(F.struct("_at", "_row")).alias("_cut")).collect()}
    leaves = local_frame(spark, [(*k, *v, *edges.get(k, (None, None)), *cuts.get(k, (None, None))) for k, v in plan.items()], f"{known}, _cut_at long, _cut_row long")
    within = (F.col("_bucket") < F.col("_edge")) | ((F.col("_bucket") == F.col("_edge")) & ((F.col("_at") < F.col("_cut_at")) | ((F.col("_at") == F.col("_cut_at")) & (F.col("_row") <= F.col("_cut_row")))))
    return place(leaves).select(*LEAF, "_key", "_size", (F.col("_epochs") + F.when(within, 1).otherwise(0)).alias("n_uses")).where("n_uses > 0")
