"""Mixing sources to target weights.

Each source's documents are dealt by hash into blocks, a radix tree of 256 ways. A source's share of the mix is whole
epochs of all its blocks plus a part: blocks in order of the hash that dealt them, seeded and hence random, until the target is
reached, the block where it is reached being cut the same way one level deeper, down to a leaf of some hundred documents
on both sides of the cut, which fill what is left (see fill). The drawn block
quotas are then split among output shards by a multivariate-hypergeometric splitting tree: each node draws how many
blocks of every source go left, exact in total and in each source, so a shard's make-up is that of a uniform shuffle
of all blocks. A shard takes disjoint runs of each source's permuted blocks and shuffles its rows locally.

The driver holds numbers for sources, blocks of the first level (256 a source) and leaves, never documents. Documents
find their block by their own hash, so texts are not shuffled until they are written.

Defined results: a null source is a source of its own, last in order; a null text has size 0; documents of size 0 are
taken once with each epoch of their block; rows with equal ids and texts lie in one block, and where the cut falls among
them, a share of them is taken, drawn by their places in the table; an empty table gives an empty result. Reruns on the
same table agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, small_table, stash, without

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf that is filled one by one, and those of them that are chosen by the best of all their subsets.
LEAF, LAST = 500, 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets in proportion to the weights that sum to `total`, none above `most` times its size; the excess is reshared."""
    target, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        if weight <= 0:
            break
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def fill(sizes: np.ndarray, left: float) -> np.ndarray:
    """Which documents of a leaf are taken: in their order what fits, then, as long as that comes nearer, one more, one
    less, or one in another's place; at last, if that comes nearer still, those of the last LAST that do so together."""
    taken = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes):
        if n <= left:
            taken[i], left = True, left - n
    while True:
        # place -1 stands for no document
        out, into = np.r_[-1, np.flatnonzero(taken)], np.r_[-1, np.flatnonzero(~taken)]
        size = np.r_[sizes, 0.0]
        into = into[np.argsort(size[into], kind="stable")]
        near = np.searchsorted(size[into], left + size[out])
        pick = np.column_stack([np.clip(near - 1, 0, len(into) - 1), np.clip(near, 0, len(into) - 1)])
        gap = np.abs(left + size[out][:, None] - size[into][pick])
        a, b = np.unravel_index(gap.argmin(), gap.shape)
        if gap[a, b] >= abs(left) - 1e-9:
            break
        left += size[out[a]] - size[into[pick[a, b]]]
        for at, now in ((out[a], False), (into[pick[a, b]], True)):
            if at >= 0:
                taken[at] = now
    want = left + sizes[-LAST:][taken[-LAST:]].sum()
    last = best_subset(sizes[-LAST:], want)
    if abs(want - sizes[-LAST:][last].sum()) < abs(left) - 1e-9:
        taken[-LAST:] = last
    return taken


def best_subset(sizes: np.ndarray, want: float) -> np.ndarray:
    """Which of a few documents have the sum nearest to `want`: sums of one half are looked up among those of the other."""

    def sums(some: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for n in some:
            out = np.concatenate([out, out + n])
        return out

    half = len(sizes) // 2
    a, b = sums(sizes[:half]), sums(sizes[half:])
    order = np.argsort(b, kind="stable")
    near = np.searchsorted(b[order], want - a)
    pick = order[np.column_stack([np.maximum(near - 1, 0), np.minimum(near, len(b) - 1)])]
    i, j = np.unravel_index(np.abs(want - a[:, None] - b[pick]).argmin(), pick.shape)
    which = int(i) | int(pick[i, j]) << half
    return np.array([which >> k & 1 for k in range(len(sizes))], bool)


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources]: exact block quotas of every shard; each node draws its left half without replacement.

    Shards get equal numbers of blocks, to within one.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, q: np.ndarray, node: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        total = int(q.sum())
        base, more = divmod(total, hi - lo)
        n_left = base * (mid - lo) + min(more, mid - lo)
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(q, n_left, method="marginals") if total else np.zeros_like(q)
        split(lo, mid, left, 2 * node)
        split(mid, hi, q - left, 2 * node + 1)

    split(0, shards, quotas.astype(np.int64), 1)
    return out


@dataclass
class MixPlan:
    """What the mix takes, for each source: whole epochs of all documents, one more of those with a hash below `below`,
    and one more of the leaf documents named; and the shard of every drawn block."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    epochs: list[int]
    below: list[int]
    leaves: list[tuple[int, int, float]]  # source number, document hash, share of the rows with that hash
    blocks: list[tuple[int, int, int, int]]  # source number, copy, block, shard
    shards: int = 16


def _head(h: Column) -> Column:
    """The first 56 bits of a hash, as a number from 0."""
    return F.shiftrightunsigned(h, 8)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds __s, __n (words) and __h, the hash that deals a document to its block: of its id and its text."""
    return docs.withColumns({"__s": col(source_col).cast("string"), "__n": n_words(col(text_col)), "__h": F.xxhash64(F.lit(seed), col(id_col), col(text_col))})


def make_plan(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> MixPlan:
    """Plan a mix of share * all words, no source above `most` times its own.

    Sources in code-point order, null last, take the weights in turn.
    """
    rows = stash(_sized(docs, id_col, text_col, source_col, seed).select("__s", "__n", "__h"))
    totals = {r["__s"]: int(r["n"]) for r in rows.groupBy("__s").agg(F.sum("__n").alias("n")).collect()}
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    epochs = [int(t // s) if s else 1 for t, s in zip(targets, sizes, strict=True)]
    left = [t - e * s if s else 0.0 for t, e, s in zip(targets, epochs, sizes, strict=True)]
    below, leaves = [0] * len(names), []
    n_blocks = [0] * len(names)
    numbered = rows.join(F.broadcast(_numbers(docs, names)), F.col("__s").eqNullSafe(F.col("__name")))

    # descend: of every source, the 256 blocks inside the block in which its target falls
    at = {i: (0, 0) for i in range(len(names)) if left[i] > 1e-9}  # source -> level, prefix
    ends: dict[int, tuple[int, int]] = {}  # source -> heads from, to
    while at:
        level = next(iter(at.values()))[0] + 1
        cuts = F.create_map(*[F.lit(x) for i, (_, p) in at.items() for x in (i, p)])
        inside = numbered.where(F.shiftright(_head(F.col("__h")), 64 - 8 * level).eqNullSafe(cuts[F.col("__i")]) if level > 1 else F.lit(True))
        found: dict[int, list] = {}
        for r in inside.groupBy("__i", F.shiftright(_head(F.col("__h")), 56 - 8 * level).alias("p")).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("d")).collect():
            found.setdefault(r["__i"], []).append((r["p"], int(r["n"]), r["d"]))
        deeper = {}
        for i in at:
            blocks = sorted(found.get(i, []))
            if level == 1:
                n_blocks[i] = 256
            below[i] = (blocks[-1][0] + 1) << (56 - 8 * level) if blocks else 0
            for k, (p, n, d) in enumerate(blocks):
                if n > left[i]:
                    if d > LEAF and level < 7:
                        below[i], deeper[i] = p << (56 - 8 * level), (level, p)
                        break
                    # the leaf: this block and its neighbours, in turns, as long as they are few documents
                    lo, hi = k, k + 1
                    while lo > 0 and d + blocks[lo - 1][2] <= LEAF or hi < len(blocks) and d + blocks[hi][2] <= LEAF:
                        if lo > 0 and d + blocks[lo - 1][2] <= LEAF:
                            lo -= 1
                            d += blocks[lo][2]
                            left[i] += blocks[lo][1]
                        if hi < len(blocks) and d + blocks[hi][2] <= LEAF:
                            d += blocks[hi][2]
                            hi += 1
                    ends[i] = (blocks[lo][0] << (56 - 8 * level), (blocks[hi - 1][0] + 1) << (56 - 8 * level))
                    below[i] = ends[i][0]
                    break
                left[i] -= n
        at = deeper

    # the leaves, one document after another; rows of one hash go together
    if ends:
        lo = F.create_map(*[x for i, (start, _) in ends.items() for x in (F.lit(i), F.lit(start).cast("long"))])
        hi = F.create_map(*[x for i, (_, end) in ends.items() for x in (F.lit(i), F.lit(end).cast("long"))])
        here = numbered.where((_head(F.col("__h")) >= lo[F.col("__i")]) & (_head(F.col("__h")) < hi[F.col("__i")]))
        inside_leaf: dict[int, list[tuple[int, int, int]]] = {}
        for i, h, n, d in sorted(tuple(r) for r in here.groupBy("__i", "__h").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("d")).collect()):
            inside_leaf.setdefault(i, []).append((h, n, d))
        for i, rows_ in inside_leaf.items():
            # of rows that are alike as many as fit, then single documents
            for h, n, d in rows_:
                if d > 1 and n:
                    k = min(d, int(max(left[i], 0.0) * d // n))
                    left[i] -= k * n / d
                    leaves += [(i, h, k / d)] * (k > 0)
            single = [(h, n) for h, n, d in rows_ if d == 1 or not n]
            taken = fill(np.array([n for _, n in single], float), left[i]) if single else []
            leaves += [(i, h, 1.0) for (h, _), t in zip(single, taken, strict=True) if t]

    # drawn blocks (copy, block) of every source in a random order, dealt to the shards by their quotas
    drawn = []
    for i in range(len(names)):
        # blocks of the partial epoch: up to the cut, or to the last leaf document
        part = max([-(-below[i] >> 48), *(((h & (1 << 64) - 1) >> 56) + 1 for x, h, _ in leaves if x == i)])
        units = [(c, b) for c in range(epochs[i]) for b in range(256)] + [(epochs[i], b) for b in range(min(256, part))]
        order = np.random.default_rng([seed, i]).permutation(len(units))
        drawn.append([units[k] for k in order])
    quotas = splitting_tree(np.array([len(d) for d in drawn], np.int64), shards, seed) if names else np.zeros((shards, 0), np.int64)
    blocks = []
    for i, units in enumerate(drawn):
        shard = np.repeat(np.arange(shards), quotas[:, i])
        blocks += [(i, c, b, int(s)) for (c, b), s in zip(units, shard, strict=True)]
    return MixPlan(names, sizes, targets, epochs, below, leaves, blocks, shards)


def _numbers(docs: DataFrame, names: list[str | None]) -> DataFrame:
    return small_table(docs.sparkSession, [(s, i) for i, s in enumerate(names)], "__name string, __i int")


def with_copies(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """Adds size, source_size, target, drawn (copy, shard and order_key of every drawn block that holds the row) and
    copies (their number), for every row; no shuffle.

    The tables that are broadcast have one row for each source and block, and one for each taken leaf document (at most LEAF a source).
    """
    spark = docs.sparkSession
    added = ["size", "source_size", "target", "drawn", "copies"]
    rows = _sized(without(docs, added) if {c.lower() for c in docs.columns} & set(added) else docs, id_col, text_col, source_col, seed)
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, copy, block, shard in plan.blocks:
        held.setdefault((i, block), []).append((copy, shard))
    units = small_table(spark, [(i, b, [{"copy": c, "shard": s} for c, s in sorted(d)]) for (i, b), d in held.items()], "__ui int, __ub int, __units array<struct<copy:int,shard:int>>")
    per_source = small_table(spark, [(s, i, n, float(t), e, b) for i, (s, n, t, e, b) in enumerate(zip(plan.sources, plan.sizes, plan.targets, plan.epochs, plan.below, strict=True))], "__name string, __i int, source_size long, target double, __e int, __below long")
    leaf = small_table(spark, plan.leaves, "__li int, __lh long, __share double")
    out = rows.join(F.broadcast(per_source), F.col("__s").eqNullSafe(F.col("__name")), "left")
    out = out.join(F.broadcast(leaf), (F.col("__i") == F.col("__li")) & (F.col("__h") == F.col("__lh")), "left")
    out = out.withColumn("__b", F.shiftright(_head(F.col("__h")), 48).cast("int"))
    out = out.join(F.broadcast(units), (F.col("__i") == F.col("__ui")) & (F.col("__b") == F.col("__ub")), "left")
    # the partial epoch holds only what lies below the cut, and leaf documents; rows that are alike by their places
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
    out = out.withColumn("__cut", (_head(F.col("__h")) < F.col("__below")) | F.coalesce((F.col("__share") >= 1) | (drawn < F.col("__share")), F.lit(False)))
    whole = F.filter("__units", lambda u: (u["copy"] < F.col("__e")) | F.col("__cut"))
    placed = F.transform(whole, lambda u: F.struct(u["copy"].alias("copy"), u["shard"].alias("shard"), F.xxhash64(u["shard"], u["copy"], F.col("__h")).alias("order_key")))
    out = out.withColumn("drawn", F.coalesce(placed, F.array().cast("array<struct<copy:int,shard:int,order_key:bigint>>")))
    return out.withColumns({"size": F.col("__n"), "copies": F.size("drawn")}).drop("__name", "__below", "__li", "__lh", "__share", "__s", "__n", "__ui", "__ub", "__units", "__cut", "__b", "__i", "__e", "__h")


def mix(docs: DataFrame, plan: MixPlan, **names) -> DataFrame:
    """The mix itself: the rows of docs as often as they are taken, plus copy, shard and order_key (a shard's own shuffle)."""
    chosen = with_copies(without(docs, ["copy", "shard", "order_key"]), plan, **names)
    each = chosen.withColumn("__d", F.explode("drawn"))
    each = each.withColumns({"copy": F.col("__d")["copy"], "shard": F.col("__d")["shard"], "order_key": F.col("__d")["order_key"]})
    return each.drop("__d", "drawn", "copies", "size", "source_size", "target")


#: Words that a task of a shard sorts and writes: with its Parquet buffers, some 30 MB of an executor's memory.
TASK_WORDS = 2_000_000


def in_order(mixed: DataFrame, plan: MixPlan) -> DataFrame:
    """The rows of a mix dealt to its shards' tasks by order_key and sorted there; tasks are as many as the words ask for."""
    per_shard = max(1, -(-int(sum(plan.targets)) // (plan.shards * TASK_WORDS)))
    task = F.col("shard") * per_shard + F.pmod(F.col("order_key"), F.lit(per_shard)).cast("int")
    return mixed.repartitionById(plan.shards * per_shard, task).sortWithinPartitions("shard", "order_key")


def write_mix(docs: DataFrame, plan: MixPlan, path: str, **names) -> None:
    """Write the mix, a folder for each shard; rows are dealt to a shard's tasks by order_key and sorted by it there."""
    in_order(mix(docs, plan, **names), plan).write.partitionBy("shard").parquet(path)
