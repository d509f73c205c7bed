"""Documents laid into containers of fixed capacity by swap-based local search.

A document longer than a container fills as many as it can and leaves a rest; rests and the other documents are items.
Items are dealt to blocks of bounded size. In a block a best-fit start is improved by moving items, exchanging one for
one, and two for one, out of the least filled container into fuller ones, always raising the sum of squared fills, until
containers empty. Containers that stay underfull hand their items to the next level, where they are dealt anew to blocks
of the same size, until one block is left or a level settles next to nothing.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpointed

#: Most items of a block, and the part of it that hashing aims at.
BLOCK_ITEMS, AIM = 8192, 0.8
#: Containers filled less than this are packed again at the next level, if the level settled at least this part of its items.
HANDED_ON, PROGRESS = 0.995, 0.05
#: Tasks over which a level's blocks are spread at most.
MAX_TASKS = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by falling size, each into the fullest container that holds it. Lists of item numbers."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set if a container has the gap g
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        fitting = open_gaps >> size
        if fitting:
            gap = size + ((fitting & -fitting).bit_length() - 1)
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            b, gap = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_gap[gap - size].append(b)
        open_gaps |= 1 << (gap - size)
    return bins


def _firsts(items: list[int], sizes: list[int], most: int) -> list[int]:
    """The first items of each size, in their order: others of a size bring no other exchange."""
    seen: dict[int, int] = {}
    return [i for i in items if (n := seen.get(sizes[i], 0)) < most and not seen.update({sizes[i]: n + 1})]


class _Side:
    """A container's items as an exchange sees them; kept until the container changes."""

    def __init__(self, items: list[int], sizes: list[int]) -> None:
        self.items = _firsts(items, sizes, 2)
        self.sizes = np.array([sizes[i] for i in self.items], dtype=np.int64)

    @cached_property
    def with_none(self) -> np.ndarray:
        return np.concatenate([[0], self.sizes])  # 0: a move takes nothing back

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = np.triu_indices(len(self.items), 1)
        return p, q, self.sizes[p] + self.sizes[q]


def _best_exchange(source: list[int], target: list[int], sizes: list[int], gap: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Greatest gain of the target within its gap, over all items: (gain, items from the source, items from the target)."""
    return _exchange(_Side(source, sizes), _Side(target, sizes), gap)


def _exchange(source: _Side, target: _Side, gap: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())

    def better(gains: np.ndarray) -> int | None:
        if not gains.size:
            return None
        usable = np.where(gains <= gap, gains, -1)
        k = int(usable.argmax())
        return k if usable.flat[k] > best[0] else None

    single = source.sizes[:, None] - target.with_none[None, :]
    if (k := better(single)) is not None:
        i, j = divmod(k, len(target.items) + 1)
        best = (int(single[i, j]), (source.items[i],), (target.items[j - 1],) if j else ())
    if best[0] < gap and len(source.items) > 1:  # two for one
        p, q, total = source.pairs
        gains = total[:, None] - target.sizes[None, :]
        if (k := better(gains)) is not None:
            i, j = divmod(k, len(target.items))
            best = (int(gains[i, j]), (source.items[p[i]], source.items[q[i]]), (target.items[j],))
    if best[0] < gap and len(target.items) > 1:  # one for two
        p, q, total = target.pairs
        gains = source.sizes[:, None] - total[None, :]
        if (k := better(gains)) is not None:
            i, j = divmod(k, len(p))
            best = (int(gains[i, j]), (source.items[i],), (target.items[p[j]], target.items[q[j]]))
    return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull containers: each step takes from the least filled and raises the sum of squares.

    It ends because the sum is bounded and whole, and a container nothing can leave is not tried again as a source.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    under = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    sides: dict[int, _Side] = {}

    def side(k: int) -> _Side:
        if k not in sides:
            sides[k] = _Side(bins[k], sizes)
        return sides[k]

    while len(under) > 1:
        source = under[0]
        changed = False
        for target in reversed(under[1:]):
            gain, out, back = _exchange(side(source), side(target), capacity - fill[target])
            if gain > 0 and fill[target] + gain > fill[source]:
                bins[source] = [i for i in bins[source] if i not in out] + list(back)
                bins[target] = [i for i in bins[target] if i not in back] + list(out)
                fill[source] -= gain
                fill[target] += gain
                del sides[source], sides[target]
                changed = True
                if not bins[source]:
                    break
        under = [k for k in under if bins[k] and fill[k] < capacity]
        if not changed:
            under = [k for k in under if k != source]  # nothing more leaves this one
        under.sort(key=lambda k: fill[k])
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of at most the capacity into few containers; items of size 0 go with the first container."""
    positive = [i for i, s in enumerate(sizes) if s > 0]
    packed = [[positive[i] for i in b] for b in improve(best_fit([sizes[i] for i in positive], capacity), [sizes[i] for i in positive], capacity)]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    if empty:
        packed = packed or [[]]
        packed[0] += empty
    return packed


def items_of(sized: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(full, items): containers filled by one document's parts, and what is left to pack. Both doc_id, copy, piece, tokens."""
    over = F.col("tokens") > capacity
    n_full = F.floor(F.col("tokens") / capacity).cast("int")
    full = sized.where(over).select("doc_id", "copy", F.explode(F.sequence(F.lit(0), n_full - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("tokens"))
    rest = F.pmod(F.col("tokens"), F.lit(capacity).cast("bigint"))
    items = sized.select("doc_id", "copy", F.when(over, n_full).otherwise(0).alias("piece"), F.when(over, rest).otherwise(F.greatest("tokens", F.lit(0))).alias("tokens"), over.alias("_over"))
    return full, items.where(~F.col("_over") | (F.col("tokens") > 0)).drop("_over")


def _pack_blocks(items: DataFrame, capacity: int, level: int, blocks: int) -> DataFrame:
    """Items with ``container`` and whether it is ``settled``; a block that hashing made too large is cut."""
    kind = dict(items.dtypes)["doc_id"]
    most = BLOCK_ITEMS

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        sizes = table["tokens"].to_pylist()
        block = table["block"][0].as_py()
        container, settled = [""] * len(sizes), [False] * len(sizes)
        parts = -(-len(sizes) // most)
        for part in range(parts):
            own = range(part, len(sizes), parts)
            for k, members in enumerate(pack([sizes[i] for i in own], capacity)):
                full = sum(sizes[own[i]] for i in members) >= HANDED_ON * capacity
                for i in members:
                    container[own[i]], settled[own[i]] = f"{level}-{block}-{part}-{k}", full
        return table.select(["doc_id", "piece", "copy", "tokens"]).append_column("container", pa.array(container, pa.string())).append_column("settled", pa.array(settled, pa.bool_()))

    # a stated number of partitions, or adaptive execution puts many blocks, small in bytes, into one task
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(level)), F.lit(blocks).cast("bigint")))
    spread = dealt.repartition(min(blocks, MAX_TASKS), "block") if blocks > 1 else dealt
    return spread.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece int, copy bigint, tokens bigint, container string, settled boolean")


def containers(sized: DataFrame, capacity: int) -> DataFrame:
    """container_id, doc_id, piece, tokens for (doc_id, tokens): every document in one piece unless over the capacity.

    Two counts a level come to the driver. A NULL size counts as 0, as do empty documents, which lie in some container
    too; an empty table gives no rows; a document given twice is laid twice. A capacity below 1 is an error. Blocks
    follow from ids, so the result does not depend on how the input is split.
    """
    if capacity < 1:
        raise ValueError(f"a container of {capacity} tokens holds nothing")
    copies = sized.groupBy("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    single = copies.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    full, items = items_of(single, capacity)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = full.select(F.concat_ws("-", F.lit("full"), text("doc_id"), text("copy"), text("piece")).alias("container_id"), "doc_id", "piece", "tokens")
    rest = checkpointed(items)
    n = rest.count()
    level = 0
    while True:
        blocks = max(1, math.ceil(n / (AIM * BLOCK_ITEMS))) if n > BLOCK_ITEMS else 1
        packed = _pack_blocks(rest, capacity, level, blocks)
        laid = lambda rows: rows.select(F.col("container").alias("container_id"), "doc_id", "piece", "tokens")
        if blocks == 1:
            return out.unionByName(laid(packed))
        packed = checkpointed(packed)
        rest = packed.where(~F.col("settled")).select("doc_id", "piece", "copy", "tokens")
        left = rest.count()
        if n - left < PROGRESS * n:
            return out.unionByName(laid(packed))
        out = out.unionByName(laid(packed.where("settled")))
        n, level = left, level + 1


def fill_report(packed: DataFrame, by: list[str]) -> DataFrame:
    """``by``, containers, tokens, used (part of the capacity), and the least number of containers possible."""
    total = packed.groupBy(*by, "capacity").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select(*by, "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))


def document_containers(sized: DataFrame, sizes: DataFrame) -> DataFrame:
    """container_name, capacity, container_id, doc_id, piece, tokens for every row of a small table of container sizes."""
    out = None
    for r in sorted(sizes.select("container_name", "capacity_tokens").dropna().distinct().collect()):
        one = containers(sized, r["capacity_tokens"]).select(F.lit(r["container_name"]).alias("container_name"), F.lit(r["capacity_tokens"]).alias("capacity"), "container_id", "doc_id", "piece", "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no container size is given")
    return out
