"""Budgets, quotas, samples, splits, packing and balanced assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeded import hex_int, key_bucket, key_fraction, order_key, slice_of
from ..session import SALTS, lookup_join, settle
from .ordering import key_at, per_group_limit, prefix_select, prefix_select_all, seeded_index, total_before


def seeded_limit(rows: DataFrame, group: list[str], key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows per group in seeded order, however large a group is."""
    targets = rows.select(*group).distinct().withColumn("target", F.lit(k))
    return prefix_select(rows, targets, group, [key], F.lit(1), seed)


# ---- budgets ---------------------------------------------------------------------------------------------------


def scale_allocation(stats: DataFrame, mix: DataFrame, rows: int) -> DataFrame:
    """``source, allocated, target``: every source keeps one fraction of its allocation so that about ``rows`` remain.

    fraction = rows / sum over sources of (allocation / mean tokens per row).
    """
    means = stats.filter("n > 0").groupBy("source").agg((F.sum("n") / F.count("*")).alias("mean_n"))
    sized = mix.join(means, "source")
    total = sized.agg(F.sum(F.col("allocated") / F.col("mean_n")).alias("t")).scalar()
    return sized.select("source", "allocated", (F.col("allocated") * (F.lit(float(rows)) / total)).alias("target"))


def budget_select(stats: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``source, id, n`` of the rows taken: per source a random prefix that reaches its token target.

    ``stats`` should be a written table (it is read three times).
    """
    return prefix_select(
        stats.filter("n > 0").select("source", "id", "n"), targets.select("source", "target"), ["source"], ["id"], "n", seed
    )


def allocation_status(mix: DataFrame, stats: DataFrame, whole: bool = False) -> DataFrame:
    """``source, allocated, store_tokens, status``; sources without statistics are kept and say so."""
    store = stats.filter("n > 0").groupBy("source").agg(F.sum("n").alias("store_tokens"))
    status = F.when(F.col("store_tokens").isNull(), F.lit("no stats"))
    if whole:
        status = status.otherwise(F.lit("whole"))
    else:
        status = (
            status.when(F.col("store_tokens") < F.col("allocated"), F.lit("below"))
            .when(F.col("store_tokens") == F.col("allocated"), F.lit("exact"))
            .otherwise(F.lit("ok"))
        )
    return mix.join(store, "source", "left").select("source", "allocated", "store_tokens", status.alias("status"))


def refuse_partial(status: DataFrame) -> None:
    """Stop when a source has no statistics or holds less than its allocation."""
    bad = status.filter(F.col("status").isin("no stats", "below"))
    names = [r.source for r in bad.select("source").orderBy("source").limit(3).collect()]
    if names:
        raise ValueError(f"refusing a partial selection, e.g. {names}")


def budget_report(stats: DataFrame, mix: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per source: allocation, store, selected rows and tokens, status."""
    taken = chosen.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n").alias("selected_tokens"))
    return (
        allocation_status(mix, stats)
        .join(targets.select("source", F.floor("target").alias("target_tokens")), "source", "left")
        .join(taken, "source", "left")
        .select(
            "source",
            "allocated",
            "target_tokens",
            "store_tokens",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"),
            "status",
        )
    )


def shards_to_budget(rows: DataFrame, budget: float, seed: int, shard: str = "shard") -> DataFrame:
    """Whole random shards until the budget is reached; the last shard is never used."""
    sizes = rows.groupBy(shard).agg(F.sum("n").alias("tokens"), F.count("*").alias("n_rows"))
    last = rows.agg(F.max(shard).alias("m")).scalar()
    return prefix_select_all(sizes.filter(F.col(shard) < last), [shard], "tokens", budget, seed)


# ---- samples ---------------------------------------------------------------------------------------------------


def seeded_shuffle(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """All rows in seeded order (a range-partitioned sort)."""
    return rows.withColumn("__h", order_key(seed, key)).orderBy("__h", key).drop("__h")


def require_rows(rows: DataFrame, n: int, what: str) -> None:
    """Stop when a written selection has fewer rows than were asked for."""
    found = rows.count()
    if found < n:
        raise ValueError(f"{what}: {n} rows asked for, {found} there")


def sample_n(rows: DataFrame, n: int, seed: int, key: str, allow: DataFrame | None = None, workers: int = 1) -> DataFrame:
    """``n`` rows without replacement, optionally only from ``allow`` keys, with the worker each is dealt to.

    Only keys are ordered; whole rows are fetched for the keys drawn. Fewer than ``n`` keys stop the job.
    """
    keys = rows.select(key)
    pool = settle(keys if allow is None else keys.join(allow.select(key), key, "left_semi"), "pool")
    picked = settle(prefix_select_all(pool, [key], F.lit(1), n, seed), "picked")
    require_rows(picked, n, "sample")
    draws = settle(seeded_index(picked, seed, [key], "draw").withColumn("worker", F.col("draw") % workers), "draws")
    return rows.join(draws, key)


def sample_replace(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` draws with replacement: ``draw`` and the row drawn; a row drawn twice appears twice."""
    indexed = settle(seeded_index(rows.select(key), seed, [key], "row_index"), "index")
    size = indexed.count()
    draws = rows.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.pmod(hex_int(F.substring(order_key(f"{seed}:draw", F.col("id")), 1, 13)), F.lit(size)).alias("row_index"),
    )
    return draws.join(indexed, "row_index").select("draw", key)


def stratified_sample(rows: DataFrame, stratum: str, k: int, seed: int, key: str) -> DataFrame:
    return seeded_limit(rows, [stratum], key, k, seed)


def take_first(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def every_kth(rows: DataFrame, k: int, index: str) -> DataFrame:
    """Systematic sample by a dense index column."""
    return rows.filter(F.col(index) % k == 0)


def bernoulli(rows: DataFrame, rate: float, seed: int, key: str) -> DataFrame:
    return rows.filter(key_fraction(order_key(seed, key)) < rate)


def repeat_shuffled(rows: DataFrame, repeats: int, seed: int, key: str) -> DataFrame:
    """``repeats`` copies of the set, each with its own random position per row."""
    copies = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = copies.withColumn("__h", order_key(seed, "repeat", key))
    return total_before(
        keyed, ["repeat"], ["__h", key], slice_of(F.col("__h")), F.lit(1).cast("bigint"), "position"
    ).drop("__h")


def heaviest_first(rows: DataFrame, weight: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(weight), key)


def capped_sample(
    rows: DataFrame, group: str, bucket: str, cap: int, n: int, seed: int, key: str, spare: float = 1.2
) -> DataFrame:
    """Per bucket at most ``cap`` rows of one group, then ``n`` rows plus a spare share, in seeded order.

    ``short_buckets`` names the buckets that have fewer than ``n``.
    """
    h = "__h"
    keyed = rows.withColumn(h, order_key(seed, bucket, key))
    capped = per_group_limit(keyed, [bucket, group], [h, key], cap, "__r").drop("__r")
    wanted = int(n * spare + 1e-9)
    targets = rows.select(bucket).distinct().withColumn("target", F.lit(wanted))
    return prefix_select(capped.drop(h), targets, [bucket], [key], F.lit(1), seed)


def short_buckets(sample: DataFrame, bucket: str, n: int) -> DataFrame:
    """``bucket, n_rows, missing`` of the buckets with fewer than ``n`` rows."""
    sizes = sample.groupBy(bucket).agg(F.count("*").alias("n_rows"))
    return sizes.filter(F.col("n_rows") < n).withColumn("missing", F.lit(n) - F.col("n_rows"))


# ---- splits ----------------------------------------------------------------------------------------------------


def positional_split(rows: DataFrame, ratio: float, seed: int, key: list[str]) -> DataFrame:
    """``row_index`` in the seeded order and ``is_val`` for the last (1 - ratio) of the rows."""
    indexed = settle(seeded_index(rows, seed, key), "indexed")
    first_val = int(indexed.count() * ratio)
    return indexed.withColumn("is_val", F.col("row_index") >= first_val)


def split_at_ratio(rows: DataFrame, ratio: float, seed: int, key: list[str]) -> DataFrame:
    """``is_val`` for the last (1 - ratio) of the rows in the seeded order, as ``positional_split`` without the index.

    The key at the cut is found from counts; rows are then compared with it where they are, so nothing is numbered or moved.
    The key must be unique: repeated keys would stay on one side.
    """
    cut = key_at(rows, seed, key, lambda n: int(n * ratio))
    if cut is None:
        return rows.withColumn("is_val", F.lit(False))
    at = F.struct(F.lit(cut["__h"]), *[F.lit(cut[c]).cast(rows.schema[c].dataType) for c in key])
    own = F.struct(order_key(seed, *key), *[F.col(c) for c in key])
    return rows.withColumn("is_val", own >= at)


def split_ratio(n_train: int, n_total: int) -> float:
    """Ratio that gives back exactly ``n_train`` when a trainer truncates ``n_total * ratio``."""
    return (n_train + 0.5) / n_total


# ---- packing ---------------------------------------------------------------------------------------------------


def pack_rows(rows: DataFrame, length: int, seed: int, tokens_per_bucket: int) -> DataFrame:
    """Rows into sequences of at most ``length`` tokens: a pack closes when the next row does not fit.

    Buckets of about ``tokens_per_bucket`` tokens are packed on their own, in seeded order, so a task sees a bounded list
    of (id, n) however large the table is. Columns: ``id, n, bucket, pack, doc, start``.
    """
    lengths = settle(rows.select("id", "n"), "lengths")
    total = lengths.agg(F.sum("n").alias("t")).first().t or 0
    n_buckets = max(1, -(-total // tokens_per_bucket))
    keyed = lengths.withColumn("h", order_key(seed, "id")).withColumn("bucket", key_bucket(F.col("h"), n_buckets))

    def fill(part):
        part = part.sort_values(["h", "id"])
        pack, doc, start, used = [], [], [], 0
        p, d = 0, 0
        for n in part["n"]:
            if d and used + n > length:
                p, d, used = p + 1, 0, 0
            pack.append(p)
            doc.append(d)
            start.append(used)
            d, used = d + 1, used + int(n)
        return part.assign(pack=pack, doc=doc, start=start)[["id", "n", "bucket", "pack", "doc", "start"]]

    id_type = lengths.schema["id"].dataType.simpleString()
    n_type = lengths.schema["n"].dataType.simpleString()
    return keyed.groupBy("bucket").applyInPandas(
        fill, f"id {id_type}, n {n_type}, bucket bigint, pack bigint, doc bigint, start bigint"
    )


# ---- groups over shards ----------------------------------------------------------------------------------------


# A node or key with more than one in HOT_SHARE of the edges is hot: its edges are spread over SALTS salts.
HOT_SHARE = 1000
# Labels are broadcast up to so many rows.
LABEL_ROWS = 10_000


def group_components(edges: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """``node, component``: nodes that share a key, directly or through others, get the smallest node of their group.

    Every round takes the smallest label per key and per node (both combine before the shuffle, so a key shared by a third
    of the nodes costs one row per task) and then jumps to the label's own label. Rounds are written to the shared folder.
    A node or a key may hold a large share of all edges: such edges are spread over salts, found once. Labels and keys are
    joined by shuffles and never broadcast, so nothing that the driver gets grows with the edges.
    """
    edges = _salted(_salted(settle(edges.select(node, key).distinct(), "edges"), node, key, "__n"), key, node, "__k")
    edges = settle(edges, "salted")
    labels = settle(edges.groupBy(node).agg(F.min(node).alias("label"), F.max("__n_salts").alias("__n_salts")), "labels")
    while True:
        held = edges.drop("__n_salts").join(_copied(labels, "__n").hint("merge"), [node, "__n"])
        per_key = held.groupBy(key).agg(F.min("label").alias("low"), F.max("__k_salts").alias("__k_salts"))
        lowered = (
            edges.select(node, key, "__k")
            .join(_copied(per_key, "__k").hint("merge"), [key, "__k"])
            .groupBy(node)
            .agg(F.min("low").alias("low"))
            .join(labels.hint("merge"), node)
            .select(node, F.least("low", "label").alias("label"), F.col("label").alias("old"), "__n_salts")
        )
        lowered = settle(lowered, "lowered")
        if lowered.filter("label <> old").isEmpty():
            return lowered.select(node, F.col("label").alias("component"))
        jump = (
            lowered.select(F.col("label").alias(node))
            .distinct()
            .join(lowered.select(node, F.col("label").alias("further")).hint("merge"), node)
            .select(F.col(node).alias("label"), "further")
        )
        jumped = lookup_join(lowered, jump, ["label"], limit=LABEL_ROWS).select(node, F.col("further").alias("label"), "__n_salts")
        labels = settle(jumped, "labels")


def _salted(edges: DataFrame, by: str, other: str, out: str) -> DataFrame:
    """Edges with ``out``, the salt of a hot ``by`` (0 for others), and ``<out>_salts``, how many it has."""
    counts = settle(edges.groupBy(by).agg(F.count("*").alias("__rows")), "degrees")
    least = (counts.agg(F.sum("__rows").alias("t")).first().t or 0) / HOT_SHARE
    hot = counts.filter(F.col("__rows") > F.greatest(F.lit(least), F.lit(HOT_SHARE))).select(by, F.lit(SALTS).alias(f"{out}_salts"))
    marked = edges.join(F.broadcast(hot), by, "left").withColumn(f"{out}_salts", F.coalesce(f"{out}_salts", F.lit(1)))
    return marked.withColumn(out, F.pmod(F.xxhash64(other), F.col(f"{out}_salts")).cast("int"))


def _copied(side: DataFrame, salt: str) -> DataFrame:
    """One row for each of the salts of a row."""
    return side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(f"{salt}_salts") - 1)))


def balance_groups(groups: DataFrame, n: int, group: str = "component", weight: str = "weight") -> DataFrame:
    """``group, weight, shard``: heaviest group first onto the currently lightest shard, ties by group and by shard.

    The order of the weights decides everything, so only their histogram is walked: one stream of (weight, count) rows
    against ``n`` loads gives, for every weight, how many of its groups each shard takes next. A group finds its shard by
    its place among the groups of its weight, which sliced totals give.
    """
    sized = settle(groups.select(group, F.col(weight).alias("__w"), weight), "groups")
    counts = sized.groupBy("__w").agg(F.count("*").alias("c"))
    ordered = counts.repartition(1).sortWithinPartitions(F.desc("__w"))
    w_type = counts.schema["__w"].dataType.simpleString()

    def runs(batches):
        import numpy as np
        import pandas as pd

        loads = np.zeros(n)
        for part in batches:
            out = []
            for w, c in zip(part["__w"].tolist(), part["c"].tolist()):
                first = 0
                for shard in _lightest_first(loads, float(w), int(c)):
                    out.append((w, first, first + len(shard), shard.tolist()))
                    first += len(shard)
            yield pd.DataFrame(out, columns=["__w", "first", "last", "shards"])

    placed = settle(ordered.mapInPandas(runs, f"__w {w_type}, first bigint, last bigint, shards array<int>"), "runs")
    by_number = sized.schema[group].dataType.typeName() in ("byte", "short", "integer", "long")
    slices = F.floor(F.col(group) / 4096) if by_number else F.substring(F.col(group).cast("string"), 1, 4)
    nth = total_before(sized, ["__w"], [group], slices, F.lit(1).cast("bigint"), "__nth")
    binned = placed.withColumn("__bin", F.floor(F.col("first") / RUN))
    joined = lookup_join(nth.withColumn("__bin", F.floor(F.col("__nth") / RUN)), binned, ["__w", "__bin"])
    shard = F.get("shards", (F.col("__nth") - F.col("first")).cast("int"))
    return joined.select(group, weight, shard.alias("shard"))


# Groups of one weight that one row of the plan deals out.
RUN = 4096


def _lightest_first(loads, w: float, count: int):
    """Shards that take ``count`` groups of one weight in turn, ``RUN`` at a time; the loads grow with them.

    Once no two loads differ by the weight, the shards take turns in one fixed order.
    """
    import heapq

    import numpy as np

    while count:
        turn = np.empty(min(RUN, count), np.int32)
        k = 0
        heap = [(load, i) for i, load in enumerate(loads.tolist())]
        heapq.heapify(heap)
        while k < len(turn) and loads.max() - loads.min() >= w:
            load, i = heap[0]
            heapq.heapreplace(heap, (load + w, i))
            loads[i] = load + w
            turn[k] = i
            k += 1
        order = np.lexsort((np.arange(len(loads)), loads))
        turn[k:] = np.resize(order, len(turn) - k)
        loads += w * np.bincount(turn[k:], minlength=len(loads))
        count -= len(turn)
        yield turn


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The record with the greatest order per key, as an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in [*order, *others]])


# ---- neighbours under a budget ---------------------------------------------------------------------------------


def round_robin_select(knn: DataFrame, lengths: DataFrame, budget: int, seed: int, dedup: bool = False) -> DataFrame:
    """Neighbours taken round by round while whole rounds fit the token budget.

    Round r offers every query's r-th neighbour (with ``dedup`` its nearest one not taken in an earlier round; two queries
    may still take one row in the same round). The first round that does not fit whole is walked in seeded order and
    rows that no longer fit are skipped. ``knn``: ``query, rank, id, score``; ``lengths``: ``id, n``. Returns
    ``round, query, rank, id, score, n``.
    """
    near = settle(knn.join(lengths.select("id", "n"), "id").select("query", "rank", "id", "score", "n"), "near")
    offers = _offers_without_repeats(near, budget) if dedup else near.withColumn("round", F.col("rank").cast("int"))
    state = _round_ends(offers).agg(
        F.max(F.when(F.col("end") <= budget, F.struct("end", "round"))).alias("full"),
        F.min(F.when(F.col("end") > budget, F.col("round"))).alias("partial"),
    ).first()
    spent, last = (state.full.end, state.full["round"]) if state.full else (0, 0)
    taken = offers.filter(F.col("round") <= last)
    if state.partial is None:
        return taken
    return taken.unionByName(_fit_in_order(offers.filter(F.col("round") == state.partial), budget - spent, seed))


def _round_ends(offers: DataFrame) -> DataFrame:
    """``round, end``: tokens of all offers up to and with a round; as many rows as rounds."""
    running = W.orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    return offers.groupBy("round").agg(F.sum("n").alias("t")).select("round", F.sum("t").over(running).alias("end"))


def _offers_without_repeats(near: DataFrame, budget: int) -> DataFrame:
    """``near`` with the ``round`` in which a query offers the row, without the rows that it never offers.

    A query reaches a row in the round after its own offers before it, and offers it unless another query reached the row in
    an earlier round. So a row's first round is the least round in which anyone reaches it. Starting from the ranks, every
    step walks the queries' lists against those first rounds; after step m rounds up to m + 1 are final, so the steps end
    with the rounds that the budget pays for, or as soon as nothing changes, which is far earlier for long lists that overlap
    little. Lists have as many entries as neighbours were asked per query and stay inside a row.
    """
    fields = ["rank", "id", "score", "n"]

    def reached(held, x):
        # Entries so far with their rounds, and the round in which the query looks for its next row.
        offered = x["first"] >= held["turn"]
        row = F.struct(*[x[c].alias(c) for c in fields], held["turn"].alias("round"))
        return F.struct(F.concat(held["rows"], F.array(row)).alias("rows"), (held["turn"] + offered.cast("int")).alias("turn"))

    shape = ", ".join(f"{c}: {near.schema[c].dataType.simpleString()}" for c in fields)
    start = F.struct(F.array().cast(f"array<struct<{shape}, round: int>>").alias("rows"), F.lit(1).alias("turn"))
    state, step = near.withColumn("round", F.col("rank").cast("int")), 1
    while True:
        first = state.groupBy("id").agg(F.min("round").alias("first"))
        marked = settle(lookup_join(state, first, ["id"]), "marked")
        offers = marked.filter(F.col("round") == F.col("first")).drop("first")
        paid = _round_ends(offers.filter(F.col("round") <= step)).agg(F.max("end").alias("end")).first().end
        if paid is None or paid > budget:
            return offers
        lists = marked.groupBy("query").agg(
            F.sort_array(F.collect_list(F.struct(*fields, "first"))).alias("l"), F.sort_array(F.collect_list(F.struct("rank", "round"))).alias("old")
        )
        walked = lists.select("query", "old", F.aggregate("l", start, reached)["rows"].alias("rows"))
        same = F.transform("rows", lambda x: x["round"]) == F.transform("old", lambda x: x["round"])
        moved = settle(walked.select("query", "rows", same.alias("same")), "walked")
        state = moved.select("query", F.inline("rows"))
        if moved.filter(~F.col("same")).isEmpty():
            return offers
        step += 1


def _fit_in_order(offered: DataFrame, room: int, seed: int) -> DataFrame:
    """Rows in seeded order, each taken when it still fits into what is left of ``room``.

    Sliced totals give the longest prefix that fits. What is left is then less than the row behind it, and of the rows
    behind only those count that some room up to that could take: if the room is at most u before a row of n <= u tokens, it
    is at most max(n - 1, u - n) after it, skipped or taken, so u falls with every such row and larger rows are passed over.
    Every part of the order keeps these few rows (never more than u), and one stream over them takes those that fit.
    """
    columns = offered.columns
    fitting = offered.withColumn("__h", order_key(seed, "round", "query")).filter(F.col("n") <= room)
    ahead = settle(total_before(fitting, [], ["__h", "query"], slice_of(F.col("__h")), "n", "__before"), "ahead")
    stop = ahead.filter(F.col("__before") + F.col("n") > room).agg(F.min(F.struct("__h", "query", "__before")).alias("s")).first().s
    if stop is None:
        return ahead.select(*columns)
    here = F.struct("__h", "query") < F.struct(F.lit(stop["__h"]), F.lit(stop["query"]).cast(ahead.schema["query"].dataType))
    left = int(room - stop["__before"])
    free = here | (F.col("n") <= 0)
    rest = ahead.filter(~free & (F.col("n") <= left)).select("__h", "query", "id", "n")
    parts = rest.withColumn("__part", F.substring("__h", 1, PART_DIGITS)).repartition("__part")
    few = _walk(parts.sortWithinPartitions("__part", "__h", "query", "id"), left, take=False)
    taken = _walk(few.repartition(1).sortWithinPartitions("__h", "query", "id"), left, take=True)
    behind = lookup_join(ahead.filter(~free), taken.select("query", "id"), ["query", "id"], "left_semi")
    return ahead.filter(free).select(*columns).unionByName(behind.select(*columns))


# Hexadecimal digits of the seeded order that rows of one stream share: 256 streams, each walked by one task.
PART_DIGITS = 2


def _walk(ordered: DataFrame, room: int, take: bool) -> DataFrame:
    """Of rows in order, those that fit into the room left (``take``), or per part those that could fit for some room."""

    def walk(batches):
        part, left = None, room
        for batch in batches:
            keep = []
            for p, n in zip(batch["__part"].tolist(), batch["n"].tolist()):
                if p != part and not take:
                    left = room
                part = p
                keep.append(n <= left)
                if n <= left:
                    left = left - n if take else max(n - 1, left - n)
            yield batch[keep]

    return ordered.mapInPandas(walk, ordered.schema)
