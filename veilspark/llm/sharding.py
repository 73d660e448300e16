"""Operator 2: sharding by balanced label propagation.

Documents start in shards by a hash. Linked documents (members of one group: here, of equal texts) then move
towards the shard in which most of their group stands, until no move is admitted: as many as the target has capacity
left or gives away in the same round, taken by running sums, never beyond it. The state is one row for each group and shard, so that a group of any
size is moved by counts. Documents without links fill the shards up. Law `rows`: counts differ by one at most.

Defined results: a null text has size 1 and crc 0 and counts as equal to an empty one; a null or repeated id is an
ordinary row; an empty table gives an empty result. Other columns, null or clashing in name, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.runtime import buckets, join_salted, running_sum, written


def equal_text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: row (unique), spot (a hash of id and text), id, size, text_crc32, and group, the digest of the text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(docs[id_col], text).alias("spot"), docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group"))


def admitted(wishes: np.ndarray, free: np.ndarray) -> np.ndarray:
    """wishes: rows that want to go from shard (first index) to shard; free: room in each shard, not below 0. The most
    rows that may go at once, so that no shard gains more than its room: what leaves a shard is room for what comes.

    All wishes are granted first. What is then too much is refused along cheapest paths to shards that have room: a
    refusal takes a row off the target and leaves it in its shard, and may in turn allow a row refused before.
    """
    granted = wishes.copy()
    n = len(free)
    over = granted.sum(0) - granted.sum(1) - free
    while (over > 0).any():
        # excess goes from a target back to where rows came from (a refusal, cost 1), or along a refused wish (-1)
        cost = np.where(granted.T > 0, 1.0, np.inf)
        cost = np.where(wishes > granted, -1.0, cost)
        dist, via = np.where(over > 0, 0.0, np.inf), np.full(n, -1)
        for _ in range(n):
            step = dist[:, None] + cost
            near = step.argmin(0)
            better = step[near, np.arange(n)] < dist
            if not better.any():
                break
            via[better], dist = near[better], np.where(better, step[near, np.arange(n)], dist)
        at = end = int(np.where(over < 0, dist, np.inf).argmin())
        path = []
        while via[at] >= 0:
            path.append((int(via[at]), at))
            at = int(via[at])
        again = [wishes[u, v] > granted[u, v] for u, v in path]
        most = min(over[at], -over[end], *(wishes[u, v] - granted[u, v] if back else granted[v, u] for (u, v), back in zip(path, again)))
        for (u, v), back in zip(path, again):
            if back:
                granted[u, v] += most
            else:
                granted[v, u] -= most
        over[at] -= most
        over[end] += most
    return granted


def propagate(cells: DataFrame, shards: int, capacity: int) -> DataFrame:
    """cells: group, shard, n. Moves rows of a group to where most of it stands, until no move is admitted, and returns
    cells. A shard that refuses rows is no target until the others admit none. Every move makes the sum of the squares
    of n grow, so that this ends; ties are broken anew in every round."""
    load = np.zeros(shards, np.int64)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
        load[r.shard] = r.n
    shut: set[int] = set()
    k, moving = 0, False
    while True:
        rank = F.struct("n", F.pmod(F.xxhash64("group", "shard", F.lit(k)), F.lit(1 << 20)).alias("tie"))
        best = cells.where(~F.col("shard").isin(*shut)).groupBy("group").agg(F.max(F.struct(rank.alias("rank"), F.col("shard"))).alias("b")).select("group", F.col("b.shard").alias("to"), F.col("b.rank").alias("goal"))
        wishes = written(cells.join(best, "group").where((F.col("shard") != F.col("to")) & (rank < F.col("goal"))).select("group", "shard", "to", "n"), f"wishes{k}")
        wanted = np.zeros((shards, shards), np.int64)
        for r in wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # a row for each pair of shards
            wanted[r.shard, r.to] = r.n
        flow = admitted(wanted, np.maximum(0, capacity - load))
        k += 1
        if flow.any():
            moving = True
            load += flow.sum(0) - flow.sum(1)
            flows = cells.sparkSession.createDataFrame([(int(i), int(j), int(flow[i, j])) for i, j in zip(*flow.nonzero())], "shard int, to int, most long")
            ahead = running_sum(wishes, ["shard", "to"], F.pmod(F.xxhash64("group"), F.lit(256)), [F.col("group")], F.col("n"), "ahead")
            moved = ahead.join(F.broadcast(flows), ["shard", "to"]).withColumn("m", F.least("n", F.col("most") - F.col("ahead"))).where("m > 0")
            moved = written(moved.select("group", "shard", "to", "m"), f"moves{k}")
            changed = cells.unionByName(moved.select("group", "shard", (-F.col("m")).alias("n"))).unionByName(moved.select("group", F.col("to").alias("shard"), F.col("m").alias("n")))
            cells = written(changed.groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), f"cells{k}")
        refused = {int(j) for j in (wanted > flow).any(0).nonzero()[0]}
        shut |= refused
        if len(shut) == shards or not (refused or flow.any()):
            if not moving:
                return cells
            shut, moving = set(), False


def balanced_shards(rows: DataFrame, shards: int = 16) -> DataFrame:
    """rows: row (unique), spot (a stable hash by which rows are placed; that of row where missing), group, and columns to keep. Adds shard (counts
    at most one apart) and slot (gapless from 0 in each shard). Rows of equal spots are interchangeable, so that the
    layout of the table has no effect."""
    if "spot" not in rows.columns:
        rows = rows.withColumn("spot", F.xxhash64("row"))
    total = rows.count()
    base, extra = divmod(total, shards)
    quota = [base + (s < extra) for s in range(shards)]
    groups = written(rows.groupBy("group").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "groups")
    salt = F.xxhash64("row", F.lit(3))
    linked = written(join_salted(rows, groups, "group", "n_rows", total, salt, "left"), "linked")
    members = linked.where("n_rows IS NOT NULL")
    n = buckets(total)
    spot = F.xxhash64("spot", F.lit(3))
    start = F.pmod(F.xxhash64("spot", F.lit(5)), F.lit(shards)).cast("int")
    first = members.select("group", start.alias("shard")).groupBy("group", "shard").agg(F.count("*").alias("n"))
    # a start by hash may exceed the capacity by chance: what is over is left to fill up like unlinked rows
    cells = propagate(written(first, "cells"), shards, base)
    held = running_sum(cells, ["shard"], F.pmod(F.xxhash64("group"), F.lit(256)), [F.col("group")], F.col("n"), "held").withColumn("n", F.greatest(F.lit(0), F.least("n", F.lit(base) - F.col("held"))))
    laid = held.where("n > 0").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))  # at most one cell for each shard
    ends = F.aggregate("cells", F.expr("CAST(array() AS array<struct<shard:int, end:bigint>>)"), lambda a, c: F.concat(a, F.array(F.struct(c["shard"].alias("shard"), (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) + c["n"]).alias("end")))))
    laid = laid.select("group", ends.alias("ends")).join(groups, "group")
    # a hot group's rows are ranked over buckets as well
    ranked = running_sum(members.drop("n_rows"), ["group"], F.pmod(spot, F.lit(n)), [F.col("spot"), F.col("row")], F.lit(1), "rank")
    placed = join_salted(ranked, laid, "group", "n_rows", total, salt, "left").withColumn("shard", F.expr("try_element_at(filter(ends, e -> rank < e.end), 1).shard")).drop("ends", "rank", "n_rows")
    placed = written(placed.unionByName(linked.where("n_rows IS NULL").drop("n_rows").withColumn("shard", F.lit(None).cast("int"))), "placed")
    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # rows of a group that are left (those by which a start exceeded the capacity) stand in a row
    rest = running_sum(placed.where("shard IS NULL"), [], F.pmod(F.xxhash64("group"), F.lit(n)), [F.col("group"), F.col("spot"), F.col("row")], F.lit(1), "rank")
    end, fill = 0, F.lit(None).cast("int")
    for s in range(shards):
        end += quota[s] - load.get(s, 0)
        fill = F.coalesce(fill, F.when(F.col("rank") < end, s))
    whole = placed.where("shard IS NOT NULL").unionByName(rest.withColumn("shard", fill).drop("rank"))
    return running_sum(whole, ["shard"], F.pmod(spot, F.lit(n)), [F.col("spot"), F.col("row")], F.lit(1), "slot").drop("spot")
