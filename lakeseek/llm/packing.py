"""Filling fixed-capacity containers with items, at a controlled mixture.

Items wait in one queue per source. Deficit round-robin serves every queue in
proportion to its target share of tokens. Served in that order, an item's place
is known without simulating the rounds: the tokens its queue has given before
it, divided by the queue's share, is the point of the total stream at which it
comes up. These running sums are taken in two levels (per slice of a queue, then
over slices), so a queue that holds most of the corpus spreads over many tasks,
and what a queue gave too much or too little in one window or partition counts
in the next. A window of the stream is then packed on its own by best fit,
largest first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.encoding import FOLDER, token_counts
from lakeseek.session import cut, partitions

#: Containers per window: more waste less space and hold the mixture over longer stretches.
WINDOW_CONTAINERS = 256


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: items from the largest down, each into the
    fullest open container that still holds it. ``open_`` has a bit for every
    amount of free space that some container has, so the search is one shift."""
    place = [0] * len(sizes)
    open_, by_space, used = 0, {}, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_ >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            stack = by_space[space]
            container = stack.pop()
            if not stack:
                open_ &= ~(1 << space)
        else:
            container, space, used = used, capacity, used + 1
        place[i] = container
        left = space - size
        by_space.setdefault(left, []).append(container)
        open_ |= 1 << left
    return place


def _pack(window: pd.DataFrame) -> pd.DataFrame:
    window = window.sort_values(["doc_id", "start_token"], kind="stable")
    place = best_fit(window["n_tokens"].tolist(), int(window["capacity"].iloc[0]))
    number = window["window"].astype(str)
    window["container_id"] = number.str.cat([str(p) for p in place], sep="-")
    return window[["budget", "doc_id", "start_token", "n_tokens", "source", "container_id"]]


def items(sized: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """budget, capacity, source, doc_id, start_token, n_tokens: one item per
    document and budget, or, of a document larger than the capacity, one per
    piece of at most that size. A document without tokens is one item of size 0."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("long").alias("capacity")) for b, c in budgets]))
    rows = sized.select("*", each.alias("b")).select("doc_id", "source", F.col("n_tokens").alias("size"), "b.*")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.col("capacity"))
    return rows.withColumn("start_token", F.explode(starts)).withColumn(
        "n_tokens", F.least(F.col("capacity"), F.col("size") - F.col("start_token"))).drop("size")


def windows(stream: DataFrame, target: dict[str, float] | None, containers: int) -> DataFrame:
    """Add the window in which deficit round-robin serves each item. Every item
    costs its tokens and one more, so empty items too take their turn."""
    queue = ["budget", "source"]
    cost = F.col("n_tokens") + 1
    sliced = stream.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start_token"), F.lit(partitions(stream.sparkSession))))
    sums = sliced.groupBy(*queue, "slice").agg(F.sum(cost).alias("cost"))
    of_queue, of_budget = Window.partitionBy(*queue), Window.partitionBy("budget")
    before = of_queue.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    natural = F.sum("cost").over(of_queue) / F.sum("cost").over(of_budget)
    offsets = sums.select(*queue, "slice", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("offset"),
                          _share(natural, target).alias("share"))
    inside = Window.partitionBy(*queue, "slice").orderBy("doc_id", "start_token").rowsBetween(Window.unboundedPreceding, -1)
    served = sliced.withColumn("inside", F.coalesce(F.sum(cost).over(inside), F.lit(0))).join(offsets, [*queue, "slice"])
    point = (F.col("offset") + F.col("inside")) / F.col("share")
    return served.withColumn("window", F.floor(point / (F.col("capacity") * containers)).cast("long"))


def _share(natural: Column, target: dict[str, float] | None) -> Column:
    """A queue's target share: as given, else its natural one."""
    share = natural
    for source, part in (target or {}).items():
        share = F.when(F.col("source") == source, F.lit(float(part))).otherwise(share)
    return share


def pack_corpus(df: DataFrame, budgets: DataFrame, folder: str = FOLDER, target: dict[str, float] | None = None,
                containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """budget, doc_id, start_token, n_tokens, source, container_id for every
    document under every budget.

    ``df`` has doc_id (unique), text and source; a null source is a queue of its
    own, null and empty texts are items of size 0. ``budgets`` is a table of
    settings with one row per budget (budget, tokenizer, capacity), read on the
    driver. ``target`` maps sources to shares of tokens; without it windows have
    the mixture of the corpus. Nothing is split that fits the capacity; a queue
    that outlasts the others fills the last windows alone. Empty tables give an
    empty result.
    """
    rows = [r for r in budgets.select("budget", "tokenizer", "capacity").distinct().collect() if r.capacity and r.capacity > 0]
    packed = None
    for tokenizer in sorted({r.tokenizer for r in rows}):
        own = [(r.budget, r.capacity) for r in rows if r.tokenizer == tokenizer]
        named = df.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), "text")
        sized = cut(token_counts(named, ["doc_id", "source"], name=tokenizer, folder=folder))
        stream = windows(items(sized, own), target, containers)
        some = stream.select("budget", "window", "capacity", "source", "doc_id", "start_token", "n_tokens").groupBy(
            "budget", "window").applyInPandas(
            _pack, "budget string, doc_id long, start_token long, n_tokens long, source string, container_id string")
        packed = some if packed is None else packed.unionByName(some)
    if packed is None:
        return df.sparkSession.createDataFrame(
            [], "budget string, doc_id long, start_token long, n_tokens long, source string, container_id string")
    return packed
