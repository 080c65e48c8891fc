"""Mixing sources to target shares of the total tokens.

Target weights stand on a tree of domains, languages and sources. A total is handed down the tree by weight; what a leaf
can't take, because its documents may be repeated only so often, goes to its siblings first and to the other branches of
an ancestor only when all siblings are full. Each leaf then takes whole epochs of its documents and the start of one
more, in an order seeded by epoch, up to its number of tokens.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut

#: Vocabulary of the tokenizer that sizes are counted with; a parameter of every function that counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the way this public vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a leaf are put in order by parts of so many, found by their hash.
PARTS = 1 << 14
UNKNOWN = "und"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """This process's encoder for a vocabulary file of ranks."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _encoders[vocabulary] = tiktoken.Encoding("mixture", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def token_counts(vocabulary: str = VOCABULARY):
    """A column function giving a text's number of tokens; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count


@dataclass
class Node:
    """A node of the tree; a leaf has a weight and a capacity, an inner node gets its children's sums."""

    name: tuple
    weight: float = 0.0
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)

    def close(self) -> Node:
        if self.children:
            for c in self.children:
                c.close()
            self.weight, self.capacity = sum(c.weight for c in self.children), sum(c.capacity for c in self.children)
        return self


def share_out(total: float, parts: list[tuple[float, float]]) -> list[float]:
    """`total` divided by weight among (weight, capacity) parts; what full ones can't take goes to the rest by weight."""
    given = [0.0] * len(parts)
    open_ = [k for k, (w, c) in enumerate(parts) if w > 0 and c > 0]
    left = min(total, sum(parts[k][1] for k in open_))
    while open_ and left > 1e-9:
        weights = sum(parts[k][0] for k in open_)
        full = [k for k in open_ if parts[k][1] - given[k] <= left * parts[k][0] / weights]
        if not full:
            for k in open_:
                given[k] += left * parts[k][0] / weights
            break
        for k in full:
            left -= parts[k][1] - given[k]
            given[k] = parts[k][1]
        open_ = [k for k in open_ if k not in full]
    return given


def hand_down(node: Node, total: float) -> dict[tuple, float]:
    """Tokens of each leaf below `node`: shortages are made up by siblings before they reach another branch."""
    if not node.children:
        return {node.name: min(total, node.capacity)}
    given = share_out(total, [(c.weight, c.capacity) for c in node.children])
    return {k: v for c, g in zip(node.children, given, strict=True) for k, v in hand_down(c, g).items()}


def tree(leaves: list[tuple[tuple[str, ...], float, float]]) -> Node:
    """The tree of leaves given as (path from the root, weight, capacity)."""
    root = Node(())
    for path, weight, capacity in sorted(leaves):
        at = root
        for depth in range(1, len(path) + 1):
            name = path[:depth]
            child = next((c for c in at.children if c.name == name), None)
            if child is None:
                child = Node(name)
                at.children.append(child)
            at = child
        at.weight, at.capacity = weight, capacity
    return root.close()


def sized_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, n_tokens), written once. Languages in lower case; null, unknown and malformed ones are und."""
    lang = F.lower(F.trim("lang"))
    known = docs.select("doc_id", "source", F.when(lang.rlike("^[a-z]{2,3}$"), lang).otherwise(UNKNOWN).alias("lang"), token_counts(vocabulary)("text").alias("n_tokens"))
    return cut(known, "sized")


@dataclass
class Plan:
    """Tokens per leaf, and the figures they come from."""

    total: float
    exact_total: float
    leaves: list[tuple[str, str, int, float, float, int]]  # source, lang, whole epochs, rest, planned, tokens there


def plan_mixture(sized: DataFrame, targets: DataFrame, domains: dict[str, str], total: float | str = "supply") -> Plan:
    """How many tokens each (domain, language, source) leaf gives.

    `targets`: source, target_share, max_repeats; one row per source, a few thousand at most. `total`: a number of tokens;
    `supply` for all tokens of sources with a target; `exact` for the largest total at which every source that has any
    tokens meets its share. No more than all capacities is given out. A source's weight is spread over its languages as
    its tokens are; one without tokens stands in its domain with capacity 0, so its share goes to its siblings. Null,
    negative shares and repeats count as 0; with no weight or no tokens nothing is given.
    """
    wanted = {r["source"]: (max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0)) for r in targets.filter("source is not null").collect()}
    # at most one row per target and language code
    there = [
        (r["source"], r["lang"], r["n"])
        for r in sized.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).orderBy("source", "lang").collect()
    ]
    supply = {s: 0 for s in wanted}
    for s, _, n in there:
        supply[s] += n
    place = lambda s, lang: (domains.get(s, "other"), lang, s)
    leaves = [(place(s, lang), wanted[s][0] * n / supply[s], float(wanted[s][1] * n)) for s, lang, n in there if supply[s] and n]
    leaves += [(place(s, UNKNOWN), wanted[s][0], 0.0) for s in wanted if not supply[s]]
    filled = sum(wanted[s][0] for s in wanted if supply[s] and wanted[s][1])
    exact = min((wanted[s][1] * supply[s] * filled / wanted[s][0] for s in wanted if supply[s] and wanted[s][0] and wanted[s][1]), default=0.0)
    aim = {"supply": float(sum(supply.values())), "exact": exact}[total] if isinstance(total, str) else float(total)
    given = hand_down(tree(leaves), aim) if leaves else {}
    out = []
    for s, lang, n in there:
        g = given.get(place(s, lang), 0.0)
        epochs = int(g // n) if n else 0
        out.append((s, lang, epochs, g - epochs * n, g, n))
    return Plan(sum(given.values()), exact, out)


def select_documents(sized: DataFrame, plan: Plan, seed: int = 7) -> DataFrame:
    """(doc_id, source, lang, n_tokens, times): every document of the mixture and how often it appears.

    A leaf's last, partial epoch takes documents in the order of a hash of seed, epoch and doc_id until the leaf's tokens
    are reached as nearly as whole documents allow. Sums are built over hash parts first, so no task orders a whole leaf.
    Documents without tokens are left out.
    """
    spark = sized.sparkSession
    leaves = spark.createDataFrame([(s, lang, e, r) for s, lang, e, r, _, _ in plan.leaves], "source string, lang string, epochs int, rest double")
    d = sized.filter("n_tokens > 0").join(F.broadcast(leaves), ["source", "lang"])  # as many rows as the tree has leaves
    place = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    d = d.withColumn("place", place).withColumn("part", F.pmod(F.col("place"), F.lit(PARTS)))
    leaf = ["source", "lang"]
    sums = d.groupBy(*leaf, "part", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*leaf).orderBy("part")) - F.col("n")
    sums = sums.withColumn("before", before).withColumn("inside", F.col("before") + F.col("n") <= F.col("rest"))
    is_edge = ~F.col("inside") & (F.col("before") < F.col("rest"))
    cuts = sums.groupBy(*leaf).agg(F.max(F.when(F.col("inside"), F.col("part"))).alias("last"), F.max(F.when(is_edge, F.col("part"))).alias("edge"), F.max(F.when(is_edge, F.col("before"))).alias("before"))
    d = d.join(F.broadcast(cuts), leaf)  # one row per leaf
    order = Window.partitionBy(*leaf, "part").orderBy("place", "doc_id")
    at_edge = F.coalesce(F.col("part") == F.col("edge"), F.lit(False))
    taken = F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.col("rest")
    border = d.filter(at_edge).withColumn("extra", taken.cast("int"))
    rest = d.filter(~at_edge).withColumn("extra", F.coalesce(F.col("part") <= F.col("last"), F.lit(False)).cast("int"))
    times = F.col("epochs") + F.col("extra")
    return rest.unionByName(border).select("doc_id", *leaf, "n_tokens", times.alias("times")).filter("times > 0")


def mixture_shares(sized: DataFrame, chosen: DataFrame, targets: DataFrame, plan: Plan, domains: dict[str, str]) -> DataFrame:
    """One row per source of the documents or the targets, with what it gives and why it differs from its target.

    status: `no target`; `empty` without tokens; `short` where the cap keeps it under its share; otherwise `ok`.
    Documents without a source are one row with a null source.
    """
    spark = sized.sparkSession
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("supply_tokens"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").cast("long").alias("most_repeats"))
    planned: dict[str, float] = {}
    for s, _, _, _, g, _ in plan.leaves:
        planned[s] = planned.get(s, 0.0) + g
    plans = spark.createDataFrame([(s, round(g)) for s, g in planned.items()], "source string, planned_tokens long")
    all_ = chosen.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("times")), F.lit(0)).alias("_all"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    target = targets.filter("source is not null").select(F.col("source").alias("t_source"), F.col("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    joined = there.join(target, F.col("source") == F.col("t_source"), "full").withColumn("source", F.coalesce("source", "t_source")).drop("t_source")
    joined = joined.join(got, "source", "left").join(plans, "source", "left").crossJoin(F.broadcast(all_))
    share = F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("_all"))
    status = (
        F.when(F.col("target_share").isNull(), "no target")
        .when(F.coalesce("supply_tokens", F.lit(0)) == 0, "empty")
        .when(F.coalesce("planned_tokens", F.lit(0)) < F.floor(F.col("target_share") * plan.total), "short")
        .otherwise("ok")
    )
    names = F.col("source")
    domain = F.lit("other")
    for s, x in domains.items():
        domain = F.when(names == s, x).otherwise(domain)
    return joined.select(
        "source", domain.alias("domain"), zero("n_docs"), zero("supply_tokens"), "target_share", "max_repeats", zero("planned_tokens"), zero("tokens"),
        F.round(share, 6).alias("actual_share"), zero("most_repeats"), status.alias("status"), F.lit(round(plan.exact_total)).cast("long").alias("exact_total_tokens"),
    )
