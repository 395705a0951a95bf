"""Filling fixed-capacity containers by minimum bin slack.

Items are dealt by hash into shards of about SHARD_ITEMS, each packed on its own: a bin takes the longest item left
and then the combination of the other lengths that fills it most, found by a subset-sum over a bitset. Bins that
stay slack are opened again and their items dealt into fewer shards for the next round. A text above the capacity
is divided into full containers and a rest; nothing else is divided.

Undefined cases: a null or empty text has size 0, takes no room and lies in the bin of its shard's first item;
repeated ids count as separate items; an empty table gives no bin; a capacity below 1 is an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.session import cut

SHARD_ITEMS = 3_000
SLACK = 0.01  # a bin that leaves more than this share unused is opened again


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of lengths (longest first in lengths) whose sum is as near to room as can be."""
    full, steps, reach = 1 << room, [], 1
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        before, more, left, size = reach, reach, min(counts[length], room // length), 1
        while left > 0:  # multiples 1..count by doubling
            take = min(size, left)
            more |= (more << (take * length)) & mask
            left -= take
            size *= 2
        if more != before:
            steps.append((length, before))
            reach = more
        if reach & full:
            break
    best = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        while not before >> best & 1:
            chosen.append(length)
            best -= length
    return chosen


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes lie in 1..capacity."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    lengths = sorted(by_size, reverse=True)
    out, at = [0] * len(sizes), 0
    while lengths:
        first = lengths[0]
        out[by_size[first].pop()] = at
        if not by_size[first]:
            lengths.pop(0)
        for length in fullest(lengths, {n: len(by_size[n]) for n in lengths}, capacity - first):
            out[by_size[length].pop()] = at
            if not by_size[length]:
                lengths.remove(length)
        at += 1
    return out


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item", "n_tokens"], kind="stable", ignore_index=True)
    some = pdf["n_tokens"] > 0
    pdf["bin"] = 0
    if some.any():
        pdf.loc[some, "bin"] = pack(pdf.loc[some, "n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
    used = pdf.groupby("bin")["n_tokens"].transform("sum")
    pdf["used"] = used
    return pdf[["spec", "capacity", "item", "part", "start_token", "n_tokens", "round", "shard", "bin", "used"]]


PACKED = "spec string, capacity long, item long, part long, start_token long, n_tokens long, round int, shard long, bin long, used long"


def pack_items(sizes: DataFrame, specs: DataFrame, rounds: int = 3) -> DataFrame:
    """sizes(item long, n_tokens), specs(spec, capacity_tokens) -> every item, or its parts, with its container.

    specs is a short list of container kinds and is broadcast.
    """
    spec = specs.select(F.col("spec"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity >= 1").distinct()
    items = sizes.select(F.col("item").cast("long").alias("item"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")).crossJoin(F.broadcast(spec))
    cuts = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.expr("(size - 1) div capacity"), F.lit(0)))))
    parts = cuts.select("spec", "capacity", "item", F.col("part").cast("long").alias("part"), (F.col("part") * F.col("capacity")).cast("long").alias("start_token"), F.least("capacity", F.col("size") - F.col("part") * F.col("capacity")).cast("long").alias("n_tokens"))
    open_items = parts.where("n_tokens < capacity")
    whole = parts.where("n_tokens = capacity").select("*", F.lit(0).alias("round"), F.col("item").alias("shard"), F.col("part").alias("bin"), F.col("capacity").alias("used"))
    done = [whole]
    for r in range(1, rounds + 1):
        counts = {row["spec"]: row["c"] for row in open_items.groupBy("spec").agg(F.count("*").alias("c")).collect()}  # one row a spec
        if not counts:
            break
        shards = F.coalesce(*[F.when(F.col("spec") == s, F.lit(-(-c // SHARD_ITEMS))) for s, c in counts.items()], F.lit(1))
        dealt = open_items.select("*", F.lit(r).alias("round"), F.pmod(F.xxhash64("item", "part", F.lit(r)), shards).alias("shard"))
        packed = cut(dealt.groupBy("spec", "shard").applyInPandas(_pack_shard, PACKED), "packed")
        slack = F.col("used") < F.col("capacity") * (1 - SLACK)
        if r == rounds:
            done.append(packed)
        else:
            done.append(packed.where(~slack))
            open_items = packed.where(slack).select("spec", "capacity", "item", "part", "start_token", "n_tokens")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("spec", F.concat_ws("-", "round", "shard", "bin").alias("container"), "item", "part", "start_token", "n_tokens", "capacity")
