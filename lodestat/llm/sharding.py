"""K-d tree partitioning into shards of equal bytes, with DataFrame and SQL functions only.

Units, not rows, are dealt: copies of one text are one unit, so a text stays in one shard, unless its copies
weigh more than 1/64 of a shard; such hot texts are dealt in parts by a hash of doc_id. The units of a node
are split along the node's widest metadata dimension, at the weighted quantile that gives each side its share of the
shards, until every leaf is one shard. Quantiles are distributed: each round is one aggregation into at most 4096
histogram buckets a node, and zooms into the bucket that holds the cut. The driver sees those sums alone.

Defined results: null texts weigh the overhead alone and have crc32 0; null metadata sort as their own value; a null doc_id is
dealt as any row; repeated rows are rows of their own; slots number a shard's rows from 0 without gaps. An empty table gives an empty one;
with fewer units than shards some shards are empty. Other columns than the ones named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cut import cut

#: A text's copies stay together up to this part of a shard.
PART = 64
STEPS, HASH_BITS = 1 << 20, 42
BUCKETS = 4096


@dataclass
class Node:
    shards: int
    first: int
    dimension: str = ""
    cut: int = 0
    sides: list = field(default_factory=list)

    def leaf_expr(self, name) -> Column:
        """An expression that gives name(node) of the leaf that a unit falls into."""
        if not self.sides:
            return F.lit(name(self))
        return F.when(F.col(self.dimension) < self.cut, self.sides[0].leaf_expr(name)).otherwise(self.sides[1].leaf_expr(name))

    def leaves(self) -> list:
        return [x for s in self.sides for x in s.leaves()] if self.sides else [self]


def _category(c: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(c), F.lit(STEPS)), F.lit(0))


def _quantiles(units: DataFrame, label: Column, open_nodes: dict[int, Node], stats: dict) -> None:
    """Sets dimension and cut of each open node."""
    state = {}
    for i, node in open_nodes.items():
        s = stats[i]
        dims = [k[3:] for k in s.asDict() if k.startswith("lo_")]
        node.dimension = max(dims, key=lambda d: (s["hi_" + d] - s["lo_" + d], d))
        goal = s["w"] * (node.shards // 2) / node.shards
        state[i] = [s["lo_" + node.dimension], s["hi_" + node.dimension] + 1, 0, goal, s["w"] / node.shards]
    todo = dict(open_nodes)
    while todo:
        arms = [(i, todo[i].dimension, *state[i][:2]) for i in todo]
        bucket, inside = F.lit(None).cast("long"), F.lit(False)
        for i, d, lo, hi in arms:
            wide = -(-(hi - lo) // BUCKETS)
            here = (F.col("node") == i) & (F.col(d) >= lo) & (F.col(d) < hi)
            inside = inside | here
            bucket = F.when(here, F.expr(f"({d} - {lo}L) div {wide}L")).otherwise(bucket)
        rows = units.withColumn("node", label).where(inside).groupBy("node", bucket.alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["node"], []).append((r["b"], r["w"], r["n"]))
        for i in list(todo):
            lo, hi, below, goal, share = state[i]
            wide = -(-(hi - lo) // BUCKETS)
            for b, w, n in sorted(by.get(i, [])):
                if below + w >= goal or (b, w, n) == max(by[i]):
                    break
                below += w
            at, end = lo + b * wide, min(hi, lo + (b + 1) * wide)
            if w <= share / 5000 or n == 1 or end - at <= 1:
                todo[i].cut = at if goal - below < below + w - goal else end
                del todo[i]
            else:
                state[i] = [at, end, below, goal, share]


def kd_tree(units: DataFrame, shards: int, dimensions: list[str]) -> Node:
    """The tree over units (long columns dimensions, weight w)."""
    root = Node(shards, 0)
    while open_nodes := {i: n for i, n in enumerate(root.leaves()) if n.shards > 1}:
        ids = {id(n): i for i, n in enumerate(root.leaves())}
        label = root.leaf_expr(lambda n, ids=ids: ids[id(n)])
        found = units.withColumn("node", label).groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(p + d) for d in dimensions for f, p in ((F.min, "lo_"), (F.max, "hi_"))]).collect()
        stats = {r["node"]: r for r in found}
        full = {i: n for i, n in open_nodes.items() if i in stats}
        if full:
            _quantiles(units, label, full, stats)
        for i, n in open_nodes.items():
            if i not in full:
                n.dimension, n.cut = dimensions[0], 0
            n.sides = [Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)]
    return root


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, text: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row: bytes near equal, copies together but for hot texts."""
    t = F.col(text).cast("string")
    rows = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + overhead).cast("long").alias("size"), F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t).alias("h"), *[F.col(m).cast("string").alias(f"m_{m}") for m in metadata],
    )
    key = ["h", "text_crc32", "size"]
    texts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    part = max(1, total // shards // PART)
    hot = texts.where((F.col("n") > 1) & (F.col("n") * F.col("size") > part)).select(*key, F.ceil(F.col("n") * F.col("size") / part).alias("parts"))  # at most PART * shards rows
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("parts"))).otherwise(0)).drop("parts")
    key = [*key, "part"]
    grouped = rows.groupBy(*key).agg(F.sum("size").alias("w"), *[F.min(f"m_{m}").alias(f"m_{m}") for m in metadata])
    tie = F.pmod(F.xxhash64(*key), F.lit(1 << HASH_BITS))
    measure = {"d_size": F.least(F.lit(STEPS - 1), (F.log2(F.col("size").cast("double")) * (STEPS // 40)).cast("long"))} | {f"d_{m}": _category(f"m_{m}") for m in metadata}
    units = cut(grouped.select(*key, "w", *[(F.shiftleft(c.cast("long"), HASH_BITS) + tie).alias(d) for d, c in measure.items()]))
    tree = kd_tree(units, shards, list(measure))
    placed = units.select(*key, tree.leaf_expr(lambda n: n.first).cast("int").alias("shard"))
    dealt = cut(rows.select("doc_id", *key).join(placed, key).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("sub")))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most 256 * shards rows
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32"))
    return dealt.join(F.broadcast(starts), ["shard", "sub"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + number - 1).cast("long").alias("slot"))
