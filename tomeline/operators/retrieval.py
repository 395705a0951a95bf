"""Exact vector search in blocks, pooling to pages, gates and fusion.

Every function takes and gives DataFrames. Unusable vectors (null, wrong length, zero, NaN) take no part; ties go to
the smaller id or key; empty inputs give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.session import cut

BLOCK_ROWS, BLOCK_QUERIES, PAIRS, OUT_ROWS = 4_096, 2_048, 100_000, 20_000
ROW_PARTS = 12  # each gives a list for every query; the parts of the queries make the other tasks
BLOCK = "block string, n int, width int, ids binary, groups array<string>, sizes binary, masks array<string>, m binary"


def usable(df: DataFrame, vec: str = "embedding", dim: int = 64) -> DataFrame:
    v = F.col(vec)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.where((F.size(v) == dim) & (square > 0) & ~F.isnan(square))


def blocks(df: DataFrame, key: str, group: str | None, vec: str, rows: int, mask: str | None = None) -> DataFrame:
    """Rows as blocks of at most so many vectors, those of one group side by side: the groups with their numbers of rows,
    and the vectors as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                coded = part.column("g").dictionary_encode(null_encoding="encode")
                order = np.lexsort((part.column("k").to_numpy(), coded.indices.to_numpy()))
                part, n = part.take(pa.array(order)), part.num_rows
                v = part.column("v").flatten().to_numpy(zero_copy_only=False)
                whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
                raw = lambda x: pa.array([x.tobytes()], pa.binary())
                sizes = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
                columns = [pa.array([uuid.uuid4().hex]), pa.array([n], pa.int32()), pa.array([v.itemsize], pa.int32()), raw(part.column("k").to_numpy().astype(np.int64)), whole(coded.dictionary, pa.string()), raw(sizes), whole(part.column("mask"), pa.string()), raw(v)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.partition(" ")[0] for f in BLOCK.split(", ")])

    g, m = (F.col(c).cast("string") if c else F.lit(None).cast("string") for c in (group, mask))
    return df.select(F.col(key).cast("long").alias("k"), g.alias("g"), m.alias("mask"), F.col(vec).alias("v")).mapInArrow(run, BLOCK)


class _Block:
    """A block of vectors made ready: at length one in double and single precision."""

    def __init__(self, b: pa.RecordBatch, row: int, prefix: str = "") -> None:
        get = lambda c: b.column(prefix + c)[row]
        n, kind = get("n").as_py(), np.float32 if get("width").as_py() == 4 else np.float64
        self.ids, self.sizes = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("ids", "sizes"))
        self.groups, masks = get("groups").as_py(), get("masks").values
        self.masks = None if masks.null_count == n else np.asarray(masks.to_pylist(), dtype=object)
        self.x = np.frombuffer(get("m").as_buffer(), kind).reshape(n, -1).astype(np.float64)
        self.x /= np.linalg.norm(self.x, axis=1, keepdims=True)
        self.small = self.x.astype(np.float32)
        self.starts = np.cumsum(self.sizes) - self.sizes


class _Corpus(_Block):
    """A block of rows, with its groups' codes in the task and its rows by mask."""

    def __init__(self, b: pa.RecordBatch, row: int, code: dict) -> None:
        super().__init__(b, row)
        self.codes = np.asarray([code.setdefault(g, len(code)) for g in self.groups], np.int64)
        self.known = pd.Index(self.groups, dtype=object)
        if self.masks is not None:
            codes, known = pd.factorize(self.masks)  # a row without mask has code -1
            self.by_mask, self.mask = np.argsort(codes, kind="stable"), pd.Index(known, dtype=object)
            self.ends = np.searchsorted(codes[self.by_mask], np.arange(len(known)), "right")
            self.begins = np.searchsorted(codes[self.by_mask], np.arange(len(known)))


class _Asked(_Block):
    """A block of queries and the k best groups so far of each; with own groups also these, wherever they stand."""

    def __init__(self, b: pa.RecordBatch, row: int) -> None:
        super().__init__(b, row, "q")
        self.own = np.repeat(np.asarray(self.groups, dtype=object), self.sizes)
        self.least = np.full(len(self.ids), -np.inf)
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool)
        self.new: list[tuple] = []

    def meet(self, c: _Corpus, place: np.ndarray, k: int, with_own: bool) -> None:
        slack = 1e-7 * (self.x.shape[1] + 4)  # what a product in single precision may be wrong, at most
        sims = self.small @ c.small.T
        if self.masks is not None and c.masks is not None:
            m = c.mask.get_indexer(pd.Index(self.masks, dtype=object))
            m[pd.isna(self.masks)] = -1
            i = np.flatnonzero(m >= 0)
            n = c.ends[m[i]] - c.begins[m[i]]
            ends = np.cumsum(n)
            j = c.by_mask[np.arange(n.sum()) + np.repeat(c.begins[m[i]] - (ends - n), n)]
            sims[np.repeat(i, n), j] = -np.inf
        top = np.maximum.reduceat(sims, c.starts, axis=1)
        wanted = (top >= (self.least - slack).astype(np.float32)[:, None] - np.float32(slack)) & (top > -np.inf)
        if k < len(c.groups) and np.count_nonzero(wanted) > 2 * k * len(top):
            wanted &= top >= np.partition(top, len(c.groups) - k, axis=1)[:, len(c.groups) - k, None] - np.float32(3 * slack)
        if with_own:
            own = c.known.get_indexer(pd.Index(self.own, dtype=object))
            i = np.flatnonzero(own >= 0)
            wanted[i, own[i]] = top[i, own[i]] > -np.inf
        i, g = np.nonzero(wanted)
        if not len(i):
            return
        # only rows that may be the best of their group are compared exactly
        sizes = c.sizes[g]
        ends = np.cumsum(sizes)
        column = np.arange(ends[-1]) + np.repeat(c.starts[g] - (ends - sizes), sizes)
        i, g, best = np.repeat(i, sizes), np.repeat(g, sizes), np.repeat(top[i, g], sizes)
        near = sims[i, column] >= best - np.float32(3 * slack)
        i, g, column = i[near], g[near], column[near]
        score = np.concatenate([np.einsum("nd,nd->n", self.x[i[a : a + PAIRS]], c.x[column[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])
        mine = own[i] == g if with_own else np.zeros(len(i), bool)
        self.new.append((i, c.codes[g], np.round(score, 9), c.ids[column], mine))
        if not len(self.held[0]) or sum(len(n[0]) for n in self.new) > k * len(top):  # until then the least of a list is merely lower
            self.merge(place, k)

    def merge(self, place: np.ndarray, k: int) -> None:
        at, grp, score, row, mine = map(np.concatenate, zip(self.held, *self.new))
        self.new = []
        if not len(at):
            return
        by = np.lexsort((row, -score, grp, at))
        once = by[np.r_[True, (at[by][1:] != at[by][:-1]) | (grp[by][1:] != grp[by][:-1])]]
        by = once[np.lexsort((place[grp[once]], -score[once], at[once]))]
        rank = np.arange(len(by)) - np.searchsorted(at[by], at[by])
        self.least[at[by][rank == k - 1]] = score[by][rank == k - 1]
        by = by[(rank < k) | mine[by]]
        self.held = at[by], grp[by], score[by], row[by], mine[by]


def nearest_groups(queries: DataFrame, rows: DataFrame, k: int, with_own: bool = False) -> DataFrame:
    """qid, grp, score, row_id, own: of blocks of queries and of rows, the k groups (and the own one) whose best row is
    nearest to each query; once for every part of the rows. A row of the query's mask is no candidate.

    A task keeps k groups a query over all its blocks, which is exact because a group's best row is among the k best groups
    of the block and of the task it lies in. Products in single precision only say which rows are compared exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names, place, asked, corpus, at = {}, [], None, {}, None, None
        for b in batches:
            for r in range(b.num_rows):
                if b.column("block")[r].as_py() != at:
                    at, corpus = b.column("block")[r].as_py(), _Corpus(b, r, code)
                    if len(code) > len(names):
                        names = list(code)
                        place = np.empty(len(names), np.int64)
                        place[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))] = np.arange(len(names))  # noqa: B023
                if (q := b.column("qblock")[r].as_py()) not in asked:
                    asked[q] = _Asked(b, r)
                    asked[q].masks = asked[q].masks if with_own else None
                asked[q].meet(corpus, place, k, with_own)
        for one in asked.values():
            one.merge(place, k)
            i, grp, score, row, mine = one.held
            for a in range(0, len(i), OUT_ROWS):
                p = slice(a, a + OUT_ROWS)
                columns = [pa.array(one.ids[i[p]]), pa.array([names[x] for x in grp[p].tolist()], pa.string()), pa.array(score[p]), pa.array(row[p]), pa.array(mine[p])]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "grp", "score", "row_id", "own"])

    # both are written once: every block of the rows meets all queries, and either would else be computed anew for each part of the other
    q, x = cut(queries, "asked"), cut(rows, "rows").coalesce(ROW_PARTS)
    pairs = x.hint("shuffle_replicate_nl").join(q.toDF(*[f"q{c}" for c in q.columns]))
    return pairs.mapInArrow(run, "qid long, grp string, score double, row_id long, own boolean")


def pooled_topk(queries: DataFrame, corpus: DataFrame, k: int, group: str = "page_id", vec: str = "embedding") -> DataFrame:
    """qid, group, score, row_id, rank: the k groups whose best row is nearest to each query."""
    near = nearest_groups(blocks(queries, "qid", None, vec, BLOCK_QUERIES), blocks(corpus, "id", group, vec, BLOCK_ROWS), k)
    best = near.repartition("qid").groupBy("qid", "grp").agg(F.max("score").alias("score"), F.min_by("row_id", F.struct(-F.col("score"), "row_id")).alias("row_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "grp"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("grp", group)


def threshold_gate(pool: DataFrame, least: float) -> DataFrame:
    return pool.where(F.col("score") >= least)


def margin_gate(pool: DataFrame, least: float, margin: float) -> DataFrame:
    """The best hit of a query if it leads the runner-up above the threshold by the margin; a missing one counts 0."""
    w = Window.partitionBy("qid").orderBy("rank")
    led = threshold_gate(pool, least).withColumns({"first": F.row_number().over(w), "lead": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return led.where((F.col("first") == 1) & (F.col("lead") >= margin)).drop("first")


def fuse(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, key, rank)."""
    both = None
    for one in lists:
        part = one.select("qid", key, (1.0 / (constant + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    score = both.groupBy("qid", key).agg(F.round(F.sum("part"), 9).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def adaptive_k(pool: DataFrame, share: float = 0.9, buffer: int = 5) -> DataFrame:
    """qid, k: cut after the sharpest drop among the first share of a list, plus a buffer, within 1..n."""
    w = Window.partitionBy("qid")
    gaps = pool.withColumns({"n": F.count("*").over(w), "gap": F.col("score") - F.lead("score").over(w.orderBy("rank"))})
    last = F.least(F.greatest(F.floor(F.col("n") * share) - 1, F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    cut_at = F.max_by("rank", F.when(F.col("rank") <= last, F.struct(F.round("gap", 9), -F.col("rank"))))
    out = gaps.groupBy("qid").agg(F.first("n").alias("n"), cut_at.alias("cut"))
    return out.select("qid", F.greatest(F.lit(1), F.least(F.col("n"), F.coalesce("cut", F.lit(1)) + buffer)).cast("long").alias("k"))


def conformal_threshold(required: DataFrame, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest finite margin, else infinity."""
    finite = required.where(F.col("required").isNotNull() & ~F.isnan("required") & (F.abs("required") < float("inf")))
    # values are counted in ranges of a thousandth, so no task orders more than one range
    counts = finite.groupBy(F.floor(F.col("required") * 1_000).alias("range"), F.round("required", 9).alias("required")).agg(F.count("*").alias("c"))
    ranges = counts.groupBy("range").agg(F.sum("c").alias("in_range"))
    whole = Window.orderBy("range")
    placed = ranges.withColumns({"before": F.sum("in_range").over(whole) - F.col("in_range"), "n": F.sum("in_range").over(Window.partitionBy())})  # a row a range
    inside = Window.partitionBy("range").orderBy("required").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(placed, "range").withColumn("upto", F.col("before") + F.sum("c").over(inside))
    pick = ranked.where(F.col("upto") >= F.ceil((F.col("n") + 1) * (1 - alpha))).agg(F.min("required").alias("t"))
    return pick.select(F.coalesce("t", F.lit(float("inf"))).alias("threshold"))


def first_seen(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
