"""Problem 8: documents packed into containers of a fixed token capacity.

Sizes are tokens of a public tokenizer. Documents spread by hash over shards of bounded size; each shard is
packed by best fit on falling sizes and then improved by local search between underfull containers: a move
of one document, an exchange of one for one, or of two for one, is made when it raises the sum of squared
fills, so that fuller containers get fuller until others are empty. What a shard leaves underfull is packed
again among the leftovers of other shards. Only a document that alone exceeds the capacity is cut.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.runtime import cut, table

CAPACITY = 4096
#: Where the vocabulary files of public tokenizers lie; a parameter of the session's environment.
TOKENIZERS = os.environ.get("LOOMTEXT_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Splits text before the merges; fixed value that goes with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items in a shard; rounds of packing leftovers; a container this full is final before the last round.
SHARD_ITEMS, ROUNDS, FINAL_FILL = 20_000, 3, 0.995
#: Containers of a neighbourhood that the search for exchanges looks at, and its passes.
NEIGHBOURS, PASSES = 40, 6
MAX_PARTITIONS = 20_000


@lru_cache(4)
def encoding(folder: str = TOKENIZERS):
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id, text); null and empty texts have no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pd.Series(n, dtype="int64", index=pdf.index)})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


class Bin:
    __slots__ = ("fill", "items")

    def __init__(self) -> None:
        self.fill = 0
        self.items: list[tuple[int, int]] = []  # (size, item), falling

    def add(self, size: int, item: int) -> None:
        self.items.append((size, item))
        self.fill += size

    def drop(self, k: int) -> tuple[int, int]:
        size, item = self.items.pop(k)
        self.fill -= size
        return size, item


def best_fit(sizes: list[int], capacity: int) -> list[Bin]:
    """Best fit on falling sizes: each item goes where it leaves the least room."""
    bins: list[Bin] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b, free = len(bins), capacity
            bins.append(Bin())
        bins[b].add(size, item)
        if free - size > 0:
            insort(room, (free - size, b))
    return bins


def improve(bins: list[Bin], capacity: int) -> list[Bin]:
    """Local search between underfull bins; every step raises the sum of squared fills, so it ends."""
    for _ in range(PASSES):
        under = sorted((b for b in bins if b.fill < capacity), key=lambda b: -b.fill)
        changed = False
        for i, big in enumerate(under):
            for small in under[i + 1 : i + 1 + NEIGHBOURS] + under[-NEIGHBOURS:]:
                if small is big or not small.items or big.fill == capacity or small.fill > big.fill:
                    continue
                changed |= step(big, small, capacity)
        bins = [b for b in bins if b.items]
        if not changed:
            break
    return bins


def step(big: Bin, small: Bin, capacity: int) -> bool:
    """The best of a move, a one-for-one and a two-for-one exchange that fills big from small."""
    free = capacity - big.fill
    best: tuple[int, int, list[int], int | None] = (0, 0, [], None)
    mine = sorted((s, k) for k, (s, _) in enumerate(big.items))
    sizes = [s for s, _ in mine]
    others = sorted(((s, k) for k, (s, _) in enumerate(small.items)), reverse=True)
    for s, k in others:
        if s <= free and s > best[0]:
            best = (s, 1, [k], None)
        # one for one: an item of big smaller than s by as much of the free room as possible
        at = bisect_left(sizes, s - free)
        if at < len(sizes) and sizes[at] < s and s - sizes[at] > best[0]:
            best = (s - sizes[at], 2, [k], mine[at][1])
    if best[0] < free:
        few = others[:24]
        for a in range(len(few)):
            for b in range(a + 1, len(few)):
                s = few[a][0] + few[b][0]
                at = bisect_left(sizes, s - free)
                if at < len(sizes) and sizes[at] < s and s - sizes[at] > best[0]:
                    best = (s - sizes[at], 3, [few[a][1], few[b][1]], mine[at][1])
    gain, _, take, give = best
    if gain <= 0 or (big.fill + gain) ** 2 + (small.fill - gain) ** 2 <= big.fill**2 + small.fill**2:
        return False
    moved = [small.drop(k) for k in sorted(take, reverse=True)]
    if give is not None:
        small.add(*big.drop(give))
    for m in moved:
        big.add(*m)
    return True


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items by container; every size is at most capacity, items of size 0 need no container."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    keep = [i for i, s in enumerate(sizes) if s > 0]
    bins = improve(best_fit([sizes[i] for i in keep], capacity), capacity)
    return [[keep[i] for _, i in b.items] for b in bins]


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers for sizes(doc_id, n_tokens).

    Returns (container_id, doc_id, start_token, n_tokens): one row per document, more for one that exceeds
    the capacity: its full pieces are containers of their own, the rest is packed like a document. Documents
    without tokens (null or empty text) get a null container. Repeated and null ids are packed each.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    known = cut(sizes.withColumn("row", F.monotonically_increasing_id()))
    full = known.where(F.col("n_tokens") >= capacity).select(
        "row", "doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"n_tokens div {capacity} - 1"))).alias("k")
    ).select(
        F.concat(F.lit("f-"), "row", F.lit("-"), "k").alias("container_id"), "doc_id",
        (F.col("k") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"),
    )
    rest = known.where(F.col("n_tokens") % capacity > 0).select(
        "doc_id", (F.floor(F.col("n_tokens") / capacity) * capacity).cast("bigint").alias("start_token"), (F.col("n_tokens") % capacity).alias("n_tokens")
    )
    none = known.where("n_tokens = 0").select(
        F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).cast("bigint").alias("start_token"), "n_tokens"
    )
    done = [full, none]
    todo = rest
    for level in range(ROUNDS):
        n = todo.count()
        if n == 0:
            break
        shards = max(1, -(-n // SHARD_ITEMS))
        last = level == ROUNDS - 1 or shards == 1
        spread = F.pmod(F.xxhash64("doc_id", "start_token", "n_tokens", F.lit(level)), F.lit(shards))
        # so many partitions by hand, else the few bytes of all shards would be put into one task
        packed = cut(todo.withColumn("shard", spread).repartition(min(shards, MAX_PARTITIONS), "shard").groupBy("shard").applyInPandas(
            _pack_shard(capacity, level), "container_id string, doc_id bigint, start_token bigint, n_tokens bigint, fill bigint"
        ))
        final = packed if last else packed.where(F.col("fill") >= FINAL_FILL * capacity)
        done.append(final.drop("fill"))
        if last:
            break
        todo = packed.where(F.col("fill") < FINAL_FILL * capacity).select("doc_id", "start_token", "n_tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("container_id", "doc_id", "start_token", "n_tokens")


def _pack_shard(capacity: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start_token"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].tolist()
        rows = []
        for b, items in enumerate(pack(sizes, capacity)):
            fill = sum(sizes[i] for i in items)
            rows += [(f"p{level}-{key[0]}-{b}", i, fill) for i in items]
        at = [i for _, i, _ in rows]
        out = pdf.iloc[at][["doc_id", "start_token", "n_tokens"]].reset_index(drop=True)
        return out.assign(container_id=[c for c, _, _ in rows], fill=[f for _, _, f in rows])[["container_id", "doc_id", "start_token", "n_tokens", "fill"]]

    return run


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document."""
    return pack_documents(token_sizes(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: their number, tokens, the fewest containers possible, and the fill."""
    per = p8_packed(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("fill") / CAPACITY), F.lit(0)).alias("fewest"),
        F.coalesce(F.round(F.sum("fill") / (F.count(F.lit(1)) * CAPACITY), 6), F.lit(0.0)).alias("fill_rate"),
    )
