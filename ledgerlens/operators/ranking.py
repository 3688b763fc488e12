"""Scores of unseen items: truncated Katz, shares of product groups, association rules; and top lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import sparse, walks
from ledgerlens.operators.graph import checkpointed, multiply, scale, symmetric_normalise
from ledgerlens.operators.lineage import stored
from ledgerlens.operators.ordering import numbered

#: Shards that pairs are counted in, at least where there are as many items, and bytes of a shard's pairs, about, of 8 each.
SHARDS = 64
SHARD_BYTES = 64 << 20


def katz_steps(beta: float, max_iter: int = 100, tolerance: float = 1e-10) -> int:
    """How often the loop multiplies: it stops when the power of beta falls below the tolerance, before a multiplication."""
    steps, power = 0, 1.0
    while steps < max_iter and power >= tolerance:
        power *= beta
        steps += 1
    return steps


def katz(edges: DataFrame, beta: float, max_iter: int = 100, tolerance: float = 1e-10, normalise: bool = False, most_per_row: int | None = None, rows: DataFrame | None = None, columns: DataFrame | None = None, include_self: bool = False, places: int | None = None) -> DataFrame:
    """K = A + beta A^2 + beta^2 A^3 + ..., truncated.

    Without `most_per_row`, rows and columns stand alone, so only the rows (a table i) or the columns (a
    table j) asked for are carried through: X becomes X A, or Y becomes A Y. Rows go through all steps in one task
    (`walks`), which stores no product. Few columns, such as the
    groups of a graph of customers and groups, keep every step as small as customers times columns. With
    `most_per_row`, the rows of all nodes are pruned in every step and A is multiplied from the left in units
    of equal work, which gives other numbers. Every step is checkpointed.
    """
    a = symmetric_normalise(edges) if normalise else edges
    if most_per_row:
        # The diagonal is added to all rows and columns before they are chosen.
        asked = (None, None) if include_self else (rows, columns)
        total = _pruned(a, beta, katz_steps(beta, max_iter, tolerance), most_per_row, places, *asked)
    elif columns is not None:
        total = _columns(a, columns, beta, katz_steps(beta, max_iter, tolerance), None if include_self else rows)
    else:
        a = checkpointed(a)
        if a.where(~(F.col("v") > 0) | F.isnan("v") | F.col("v").isNull()).isEmpty():
            total = walks.walk_rows(a, powers(beta, katz_steps(beta, max_iter, tolerance)), rows)
        else:
            # Sums of other weights can be 0 and are entries all the same.
            total = _joined(a, beta, katz_steps(beta, max_iter, tolerance), rows)
    if include_self:
        nodes = edges.select("i").distinct()
        total = total.union(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    if include_self and most_per_row and columns is not None:
        total = total.join(columns, "j", "left_semi").select("i", "j", "v")
    return total.join(rows, "i", "left_semi") if include_self and rows is not None and (most_per_row or columns is not None) else total


def powers(beta: float, steps: int) -> list[float]:
    out, factor = [], 1.0
    for _ in range(steps):
        factor *= beta
        out.append(factor)
    return out


def katz_best(edges: DataFrame, beta: float, k: int, max_iter: int = 100, tolerance: float = 1e-10, rows: DataFrame | None = None, columns: DataFrame | None = None, places: int = 6, normalise: bool = False, most_per_row: int | None = None, cut_places: int | None = None, few_columns: bool = False) -> DataFrame:
    """The k largest entries of each row of Katz among columns without an edge from the row, of positive weights; ties go to the smaller column.

    Pruned as in `katz` with `most_per_row` (compared after rounding to `cut_places`), else unpruned; with `few_columns`, only those are carried, for all rows.
    """
    a, steps = symmetric_normalise(edges) if normalise else edges, katz_steps(beta, max_iter, tolerance)
    if most_per_row:
        return _pruned(a, beta, steps, most_per_row, cut_places, rows, columns, k, places)
    if few_columns:
        return _columns(a, columns, beta, steps, rows, k, places)
    return walks.walk_rows(a, powers(beta, steps), rows, columns, best=k, places=places)


def _joined(a: DataFrame, beta: float, steps: int, rows: DataFrame | None) -> DataFrame:
    current = a if rows is None else a.join(rows, "i", "left_semi")
    total, factor = current, 1.0
    for _ in range(steps):
        current = checkpointed(multiply(current, a))
        factor *= beta
        total = checkpointed(total.union(scale(current, factor)).groupBy("i", "j").agg(F.sum("v").alias("v")))
    return total


def _pruned(a: DataFrame, beta: float, steps: int, most: int, places: int | None, rows: DataFrame | None = None, columns: DataFrame | None = None, best: int | None = None, best_places: int = 6) -> DataFrame:
    a = stored(a.groupBy("i", "j").agg(F.sum("v").alias("v")))
    numbers = stored(sparse.node_numbers(a))
    numbered = stored(sparse.with_numbers(a, numbers))
    units = sparse.cut_units(numbered, most)
    kept = [sparse.keep(numbered)]
    for _ in range(steps):
        kept.append(sparse.multiply_rows(units, kept[-1], most, places))
    return sparse.add_powers(numbers, kept, powers(beta, steps), most, places, rows, columns, best, best_places)


def _columns(a: DataFrame, columns: DataFrame, beta: float, steps: int, rows: DataFrame | None = None, best: int | None = None, places: int = 6) -> DataFrame:
    """The columns asked for, in compact rows: a node with very many edges lies in several units, whose sums are added up."""
    a = stored(a.groupBy("i", "j").agg(F.sum("v").alias("v")))
    numbers = stored(sparse.node_numbers(a))
    asked = numbers.join(columns.select(F.col("j").alias("node")), "node", "left_semi").select(F.col("number").alias("j"))
    numbered = stored(sparse.with_numbers(a, numbers))
    units = sparse.cut_units(numbered, max(1, asked.count()), squared=False)
    kept = [sparse.keep(numbered.join(asked, "j", "left_semi"))]
    for _ in range(steps):
        kept.append(sparse.multiply_rows(units, kept[-1]))
    return sparse.add_powers(numbers, kept, powers(beta, steps), rows=rows, best=best, best_places=places)


def item_scores(scores: DataFrame, customer: str = "customer", item: str = "item") -> DataFrame:
    """The customer-item block of a graph with kinds in its node keys: (customer_id, item, score)."""
    kind = lambda c, k: F.col(c).startswith(f"{k}:")
    name = lambda c: F.substring_index(c, ":", -1)
    return scores.where(kind("i", customer) & kind("j", item)).select(name("i").alias("customer_id"), name("j").alias("item"), F.col("v").alias("score"))


def recommend(scores: DataFrame, seen: DataFrame, k: int, customer: str = "customer_id", item: str = "item", places: int = 6, items: DataFrame | None = None) -> DataFrame:
    """(customer, rank, item, score): the k best unseen items; ties by item.

    With `items`, unseen items without a score count as 0 and fill up the lists: for each customer at
    most k of them are needed, which are those that lead the items by name.
    """
    fresh = scores.join(seen.select(customer, item).distinct(), [customer, item], "left_anti")
    if items is not None:
        known = checkpointed(scores.select(customer, item).union(seen.select(customer, item)).distinct())
        bounds = known.groupBy(customer).agg((F.count(F.lit(1)) + k).cast("int").alias("bound"))
        # Of the items only the first few are numbered, as many as the longest of these lists.
        listed = items.select(item).distinct().orderBy(item).limit(_most(bounds)).withColumn("r", F.row_number().over(Window.orderBy(item)))
        rest = bounds.select(customer, F.explode(F.sequence(F.lit(1), F.col("bound"))).alias("r")).join(listed, "r").join(known, [customer, item], "left_anti").withColumn("score", F.lit(0.0))
        fresh = fresh.select(customer, item, "score").union(rest.select(customer, item, "score"))
    return ranked(fresh, k, customer, item, places)


def ranked(scores: DataFrame, k: int, customer: str = "customer_id", item: str = "item", places: int = 6) -> DataFrame:
    """(customer, rank, item, score): the k best of the items; ties by item."""
    order = Window.partitionBy(customer).orderBy(F.desc(F.round("score", places)), item)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(customer, "rank", item, "score")


def _seen(lines: DataFrame, customer: str, item: str) -> DataFrame:
    return lines.select(customer, item).distinct()


def _head(counts: DataFrame, by: Sequence[str], most: int, item: str) -> DataFrame:
    """The first `most` items of each group by count, numbered; rows beyond them leave before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("count"), item)
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def _most(bounds: DataFrame) -> int:
    return bounds.agg(F.max("bound")).first()[0] or 0


def _split_items(mine: DataFrame, popular: DataFrame, best: DataFrame, seen: DataFrame, k: int, customer: str, item: str, group: str) -> DataFrame:
    """(customer, item, score) of the unseen items in several groups that can be among the k best.

    Of an item's parts one has at least the mean, so an item that beats the k-th best of `best` has a part of
    at least that score by the number of its groups; only these are met, and then looked up in full.
    """
    several = popular.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(item))).where("m > 1")
    best = best.groupBy(customer, item).agg(F.max("part").alias("part"))
    floor = best.withColumn("r", F.row_number().over(Window.partitionBy(customer).orderBy(F.desc("part")))).where(F.col("r") == k).select(customer, F.col("part").alias("floor"))
    asked = mine.join(floor, customer, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    part = F.col("share") * F.col("count") / F.col("unseen")
    met = asked.join(several, group).where(part * F.col("m") >= F.col("floor") * (1 - 1e-9) - 1e-11).select(customer, item).distinct().join(seen, [customer, item], "left_anti")
    return met.join(several, item).join(mine, [customer, group]).groupBy(customer, item).agg(F.sum(part).alias("score"))


def _lists(mine: DataFrame, heads: DataFrame, hits: DataFrame, k: int, places: int, customer: str, item: str, both: bool = False) -> DataFrame:
    """(customer, rank, item, score, whole) of the k best unseen items of each customer; `heads` goes to every task.

    `mine` has a row (customer, g, share, unseen, bound) for each of a customer's groups, `heads` the first
    items of each group (g, r, item, count, several), `hits` the places (customer, g, r) of those that a
    customer has. With `both`, items of several groups are ranked by their parts in lists of their own, not whole, beside all others.
    """
    kinds = dict(mine.dtypes) | dict(heads.dtypes)
    parts = int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = mine.select(customer, F.struct("g", "share", "unseen", "bound").alias("own"), F.lit(None).cast("struct<g:bigint,r:int>").alias("hit"))
    own = own.union(hits.select(customer, F.lit(None).cast("struct<g:bigint,share:double,unseen:bigint,bound:int>"), F.struct("g", F.col("r").cast("int").alias("r"))))
    own = own.groupBy(customer).agg(F.collect_list("own").alias("own"), F.collect_list("hit").alias("hit")).where(F.size("own") > 0)
    own = own.select(F.pmod(F.xxhash64(customer), F.lit(parts)).alias("p"), customer, "own", "hit", F.lit(None).cast(f"struct<g:bigint,r:int,item:{kinds[item]},count:bigint,several:boolean>").alias("head"))
    head = F.struct("g", F.col("r").cast("int").alias("r"), F.col(item).alias("item"), "count", "several")
    dealt = heads.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("p"), F.lit(None).cast(kinds[customer]).alias(customer), F.lit(None).cast(dict(own.dtypes)["own"]).alias("own"), F.lit(None).cast(dict(own.dtypes)["hit"]).alias("hit"), head.alias("head")).union(own)
    dealt = dealt.repartition(parts, "p").sortWithinPartitions("p", F.asc_nulls_first(customer), F.col("head.g"), F.col("head.r"))
    schema = f"{customer} {kinds[customer]}, rank bigint, {item} {kinds[item]}, score double, whole boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read, last = [], None, None
        for batch in batches:
            names = batch.column(1)
            at = 0
            while at < batch.num_rows:
                p = batch.column(0)[at].as_py()
                if p != last:
                    held, read, last = [], None, p
                end = at + int(np.searchsorted(batch.column(0).to_numpy()[at:], p, side="right"))
                first = at + names.slice(at, end - at).null_count
                if first > at:
                    held.append(batch.column(4).slice(at, first - at))
                if end > first:
                    read = read or Heads(held)
                    yield from read.ranked(batch.slice(first, end - first), k, places, both, [customer, "rank", item, "score", "whole"])
                at = end

    return dealt.mapInArrow(run, schema)


class Heads:
    """The first items of all groups, in arrays one group after the other."""

    def __init__(self, parts: Sequence[pa.Array]):
        g, _, items, counts, several = (pa.concat_arrays([p.field(n) for p in parts]) for n in range(5))
        numbers = g.to_numpy(zero_copy_only=False)
        self.groups, self.starts, self.sizes = np.unique(numbers, return_index=True, return_counts=True)
        self.counts, self.several = counts.to_numpy(zero_copy_only=False).astype(float), several.to_numpy(zero_copy_only=False)
        self.items = items
        # Names in order, as ties go to the smaller; Python and Spark agree on the order of strings.
        self.order = np.unique(np.array(items.to_pylist(), dtype=object), return_inverse=True)[1]

    def ranked(self, batch: pa.RecordBatch, k: int, places: int, both: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
        own, hit = batch.column(2), batch.column(3)
        g, share, unseen, bound = (own.flatten().field(n).to_numpy(zero_copy_only=False) for n in range(4))
        hit_g, hit_r = (hit.flatten().field(n).to_numpy(zero_copy_only=False) for n in range(2))
        place, hit_place = np.searchsorted(self.groups, g), np.searchsorted(self.groups, hit_g)
        ends, hit_ends = np.cumsum(own.value_lengths().to_numpy()), np.cumsum(hit.value_lengths().to_numpy())
        out: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
        a = b = 0
        for n, (to, hit_to) in enumerate(zip(ends, hit_ends, strict=True)):
            at = place[a:to]
            lengths = np.minimum(bound[a:to], self.sizes[at])
            first = np.cumsum(lengths) - lengths
            index = np.repeat(self.starts[at] - first, lengths) + np.arange(lengths.sum())
            part = np.repeat(share[a:to], lengths) * self.counts[index] / np.repeat(unseen[a:to].astype(float), lengths)
            if hit_to > b:
                slot = np.argsort(at)
                slot = slot[np.minimum(np.searchsorted(at, hit_place[b:hit_to], sorter=slot), len(at) - 1)]
                gone = (at[slot] == hit_place[b:hit_to]) & (hit_r[b:hit_to] <= lengths[slot])
                fresh = np.ones(len(part), dtype=bool)
                fresh[(first[slot] + hit_r[b:hit_to] - 1)[gone]] = False
                index, part = index[fresh], part[fresh]
            a, b = to, hit_to
            if both:
                best = np.argsort(-part, kind="stable")
                best = best[np.sort(np.unique(self.order[index[best]], return_index=True)[1])[:k]]
                out.append((n, index[best], part[best], False))
                index, part = index[~self.several[index]], part[~self.several[index]]
            if len(part) > k:
                near = part >= np.partition(part, len(part) - k)[len(part) - k] - 2 * 10.0**-places
                index, part = index[near], part[near]
            best = np.lexsort((self.order[index], -sparse.decimals(part, places)))[:k]
            out.append((n, index[best], part[best], True))
            if len(out) >= 512 or n == len(ends) - 1:
                sizes = [len(i) for _, i, _, _ in out]
                who = np.repeat([o[0] for o in out], sizes)
                columns = [batch.column(1).take(pa.array(who)), pa.array(np.concatenate([np.arange(1, s + 1) for s in sizes])), self.items.take(pa.array(np.concatenate([o[1] for o in out]))), pa.array(np.concatenate([o[2] for o in out])), pa.array(np.repeat([o[3] for o in out], sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                out = []


def group_share_recommend(df: DataFrame, k: int, fallback: bool = True, customer: str = "customer_id", item: str = "item", group: str = "grp", places: int = 12, wanted: DataFrame | None = None) -> DataFrame:
    """The k best unseen items by group share, of the `wanted` customers or of all. Customers with fewer than k get the other unseen items by their rows, at a millionth of the best score.

    An item's score is the group's share of the customer's rows, dealt out by the item's rows among the
    group's unseen items. In a group all customers share one order of items, so only the first k and as many
    as the customer has seen there can be in a list. These heads of the groups go to every task, which makes
    whole lists of a customer's groups: no table has a row for each item met, and the lists aren't shuffled.
    """
    lines = df.where(F.col(customer).isNotNull() & F.col(item).isNotNull() & F.col(group).isNotNull()).select(customer, item, group)
    counts = stored(lines.groupBy(customer, item, group).agg(F.count(F.lit(1)).alias("n")))
    popular = stored(counts.groupBy(group, item).agg(F.sum("n").alias("count")))
    split = popular.groupBy(item).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(item)
    both = not split.isEmpty()
    # An item of one group is one row of a customer.
    seen = _seen(counts, customer, item) if both else counts.select(customer, item)
    mine = counts.groupBy(customer, group).agg(F.sum("n").alias("n"))
    mine = mine.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(customer))).select(customer, group, "share")
    asked = counts.select(customer).distinct()
    if wanted is not None:
        asked = asked.join(wanted, customer, "left_semi")
        mine = mine.join(wanted, customer, "left_semi")
    known = seen.join(popular, item).groupBy(customer, group).agg(F.sum("count").alias("known"), F.count(F.lit(1)).alias("bound"))
    totals = numbered(popular.groupBy(group).agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("items")), group, number="g").withColumn("g", F.col("g").cast("long"))
    totals = stored(totals)
    mine = mine.join(known, [customer, group], "left").join(totals, group)
    # A customer has rows in each of its groups, so `known` is never missing.
    mine = mine.select(customer, group, "g", "share", (F.col("all") - F.col("known")).alias("unseen"), F.least(F.col("bound") + k, "items").cast("int").alias("bound"), (F.col("items") - F.col("bound")).alias("free")).where("unseen > 0")
    mine = stored(mine)
    heads = _head(popular, [group], _most(mine), item).join(totals.select(group, "g"), group)
    heads = heads.join(split.withColumn("several", F.lit(True)), item, "left").withColumn("several", F.coalesce("several", F.lit(False)))
    heads = stored(heads.select("g", "r", item, "count", "several"))
    hits = seen.join(heads.select(item, "g", "r"), item).select(customer, "g", "r")
    if wanted is not None:
        hits = hits.join(wanted, customer, "left_semi")
    lists = lambda m, h: _lists(m, heads, h, k, places, customer, item, both)
    order = Window.partitionBy(customer).orderBy(F.desc(F.round("score", places)), item)
    if both:
        made = stored(lists(mine, hits))
        parts = made.where("not whole").select(customer, item, F.col("score").alias("part"))
        whole = _split_items(mine, popular, parts, seen, k, customer, item, group)
        scores = made.where("whole").select(customer, item, "score").union(whole)
        ranked = scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(customer, "rank", item, "score")
    else:
        ranked = lists(mine, hits).drop("whole")
    if not fallback:
        return ranked
    if both:
        ranked = stored(ranked)
        had = ranked.groupBy(customer).agg(F.count(F.lit(1)).alias("had"))
    else:
        had = mine.groupBy(customer).agg(F.sum("free").alias("had"))
    short = stored(asked.join(had, customer, "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < k).select(customer))
    if short.isEmpty():
        return ranked
    if both:
        others, ranked = ranked.join(short, customer, "left_anti"), ranked.join(short, customer, "left_semi")
    else:
        others = lists(mine.join(short, customer, "left_anti"), hits.join(short, customer, "left_anti")).drop("whole")
        ranked = stored(lists(mine.join(short, customer, "left_semi"), hits.join(short, customer, "left_semi")).drop("whole"))
    best = ranked.groupBy(customer).agg(F.max("score").alias("best"))
    items = popular.groupBy(item).agg(F.sum("count").alias("count"))
    known = seen.join(short, customer, "left_semi").join(items, item).groupBy(customer).agg(F.sum("count").alias("known"), F.count(F.lit(1)).alias("n"))
    all_rows, all_items = items.agg(F.sum("count"), F.count(F.lit(1))).first()
    # The lists of these customers hold all scored items, which are known as well.
    filled = short.join(best, customer, "left").join(known, customer).select(customer, F.coalesce(F.col("best") * 1e-6, F.lit(1e-12)).alias("scale"), (F.lit(all_rows or 0) - F.col("known")).alias("all"), F.least(F.col("n") + k, F.lit(all_items)).alias("bound"))
    filled = stored(filled.where("all > 0"))
    most = _most(filled)
    if not most:
        return others.union(ranked)
    more = filled.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("bound").cast("int")))).join(_head(items, [], most, item), "r")
    more = more.join(seen, [customer, item], "left_anti").join(ranked.select(customer, item), [customer, item], "left_anti").withColumn("score", F.col("scale") * F.col("count") / F.col("all"))
    # Equal scores after rounding: items of own groups come first, the others by their rows.
    joined = ranked.select(customer, item, "score", F.lit(None).cast("long").alias("count")).union(more.select(customer, item, "score", "count"))
    order = Window.partitionBy(customer).orderBy(F.desc(F.round("score", places)), F.desc_nulls_first("count"), item)
    return others.union(joined.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(customer, "rank", item, "score"))


class Counted:
    """How often numbers occur, added some at a time."""

    def __init__(self):
        self.keys, self.counts, self.more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.more.append(keys)
        if sum(map(len, self.more)) > max(SHARD_BYTES // 8, len(self.keys)):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers in order, and their counts."""
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.more]), return_counts=True)
        self.more = []
        if len(self.keys):
            both, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
            keys = both
        self.keys, self.counts = keys, counts
        return keys, counts


def pair_counts(baskets: DataFrame, least: int, customer: str = "customer_id", item: str = "item") -> DataFrame:
    """(i, j, n_both), both ways, of items that `least` baskets and more share; `baskets` has distinct (customer, item).

    Items are ranked by how often they occur, and dealt to shards by their rank. A basket goes to each shard that
    has one of its items, as far as the last of them: what it holds beside an item are the commoner ones before it.
    So common items come with short beginnings, and a large basket's pairs are counted by all shards, none of
    which sees all of them. A shard has pairs of some `SHARD_BYTES`, sorts them and counts, so its work grows with the pairs there are and not with those of all items.
    """
    single = baskets.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # An item of a frequent pair is frequent itself, so rare items never reach a basket.
    ranked = checkpointed(numbered(single, F.desc("n"), item).select(item, (F.col("number") - 1).cast("long").alias("rank")))
    every = ranked.count()
    lists = stored(baskets.join(ranked, item).groupBy(customer).agg(F.array_sort(F.collect_list(F.col("rank").cast("int"))).alias("ranks")).where(F.size("ranks") > 1).select("ranks"))
    n = F.size("ranks").cast("long")
    there = lists.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    shards = max(1, min(every, max(SHARDS, -(-int(there) * 8 // SHARD_BYTES))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ranks = batch.column(0)[at].values.to_numpy(zero_copy_only=False)
                # The last place of each shard's items: found first in the reversed basket.
                own, last = np.unique((ranks % shards)[::-1], return_index=True)
                ends = len(ranks) - last
                some = ends > 1
                for start in range(0, int(some.sum()), 256):
                    part = slice(start, start + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(own[some][part].astype(np.int64)), pa.array([ranks[:e] for e in ends[some][part]], pa.list_(pa.int32()))], names=["shard", "ranks"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys, counts = keys[counts >= least], counts[counts >= least]
            for start in range(0, len(keys), 200_000):
                part = slice(start, start + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part] % every), pa.array(keys[part] // every), pa.array(counts[part])], names=["a", "b", "n_both"])

        shard, held = None, Counted()
        for batch in batches:
            shards_of, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
            ranks = lists.flatten().to_numpy().astype(np.int64)
            for part in np.split(np.arange(len(ends)), np.flatnonzero(shards_of[1:] != shards_of[:-1]) + 1):
                if not len(part):
                    continue
                if shards_of[part[0]] != shard:
                    if shard is not None:
                        yield from found(*held.done())
                    shard, held = shards_of[part[0]], Counted()
                first = int(ends[part[0] - 1]) if part[0] else 0
                own = ranks[first : ends[part[-1]]]
                starts = np.repeat(ends[part] - np.diff(ends[part], prepend=first) - first, np.diff(ends[part], prepend=first))
                place = np.flatnonzero(own % shards == shard)
                before = place - starts[place]
                # Pairs of an item with those before it in its basket, some at once.
                for some in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(before) * 8 // SHARD_BYTES)) + 1):
                    n = before[some]
                    at = np.repeat(starts[place[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    held.add(np.repeat(own[place[some]], n) * every + own[at])
        if shard is not None:
            yield from found(*held.done())

    dealt = lists.select("ranks").mapInArrow(deal, "shard bigint, ranks array<int>").repartition("shard").sortWithinPartitions("shard")
    pairs = dealt.mapInArrow(count, "a bigint, b bigint, n_both bigint")
    pairs = stored(pairs)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_both"))
    names = lambda rank, name: ranked.select(F.col("rank").alias(rank), F.col(item).alias(name))
    return both.join(names("a", "i"), "a").join(names("b", "j"), "b").select("i", "j", "n_both")


def pair_rules(df: DataFrame, least: int, customer: str = "customer_id", item: str = "item") -> DataFrame:
    """Rules i => j over customers' baskets: support, confidence, lift; both ways, for pairs in at least `least` baskets."""
    baskets = stored(df.where(F.col(item).isNotNull()).select(customer, item).distinct())
    single = baskets.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pairs = pair_counts(baskets, least, customer, item)
    total = baskets.agg(F.count_distinct(customer).alias("total"))
    out = pairs.join(single.select(F.col(item).alias("i"), F.col("n").alias("n_i")), "i").join(single.select(F.col(item).alias("j"), F.col("n").alias("n_j")), "j").crossJoin(F.broadcast(total))
    return out.select("i", "j", "n_both", (F.col("n_both") / F.col("total")).alias("support"), (F.col("n_both") / F.col("n_i")).alias("confidence"), (F.col("n_both") * F.col("total") / (F.col("n_i") * F.col("n_j"))).alias("lift"))


def katz_column(edges: DataFrame, start: DataFrame, beta: float, steps: int) -> DataFrame:
    """(i, v): column of (I - beta A)^-1 for the start vector (i, v), by its Neumann series."""
    current = total = start
    for _ in range(steps):
        moved = edges.select(F.col("i").alias("to"), F.col("j").alias("i"), F.col("v").alias("w")).join(current, "i")
        current = checkpointed(moved.groupBy(F.col("to").alias("i")).agg((F.sum(F.col("w") * F.col("v")) * beta).alias("v")))
        total = checkpointed(total.union(current).groupBy("i").agg(F.sum("v").alias("v")))
    return total
