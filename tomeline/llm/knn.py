"""Most similar vectors for every vector: NN-descent over Spark joins, and greedy search on the graph it builds.

Every vector is normalised and kept as 16-bit fixed point (error of a cosine about 4e-6). Exact copies are joined
to one representative first. Nodes live in parts, made of adjacent cells around pivots so that near vectors tend to
meet; the parts only say where the work is done. Every node starts with a list out of its part (and, near the border,
of one more part that it visits): two at random, the others beside it along random projections. A round of NN-descent then compares the neighbours of each node, forward and reverse ones,
new ones with all (a sample of them at a time, until the part is quiet), and a join on the node id ships to each part the
vectors that its edges name beyond it and that it has not had before: to the source of an edge its target, to the target
its source. What a part finds for nodes of other parts goes to their lists in the next round. Rounds go on until one
changes at most DELTA of all list places.

Undefined cases: null vectors, vectors holding null, NaN or infinity and all-zero vectors have no neighbours and
give no row; vectors are compared only within one space and one length; an empty table gives an empty graph; ties
go to the smaller id; rows repeated under one id count once each as that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.session import cut, drop, drop_path, scratch_path

PIVOT_SAMPLE = 32_768  # rows the pivots are fitted on; every row is indexed
MAX_PIVOTS = 4_096  # bounds the pivots sent to the tasks (1 MB at 64 numbers a vector)
ROWS_PER_PIVOT = 540
CELL_ROWS = 3_072  # a cell with more is cut along a projection
PART_ROWS = 50_000
LIST = 14  # neighbours kept for each node, of which the nearest k are given
SAMPLE = 5  # new and old, forward and reverse neighbours of a node compared at a time
DELTA = 0.002  # share of list places whose change is not worth another step or round
LEAST_PARTS = 32
PROJECTIONS = 12
BUNDLED = 65_536  # rows that a task sorts by part before it sends them
DIMS = 1_000_000  # space * DIMS + length names a set of comparable vectors


def _binary(rows: np.ndarray) -> pa.Array:
    """Equal rows of bytes as one binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape[0], rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have this width, as a matrix of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), width)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length as a string: bytes of equal weight lie side by side, as the high ones hardly differ."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return np.int64(n).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unsqueeze(packed: list[bytes], *kinds: str) -> tuple[np.ndarray, ...]:
    """The columns of several such strings, one after another; a kind of many bytes gives a matrix."""
    widths = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[np.zeros((0, w), np.uint8)] for w in widths]
    for b in packed:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        planes, at = np.frombuffer(pa.decompress(b[8:], n * sum(widths), "zstd"), np.uint8).reshape(-1, n), 0
        for column, w in zip(out, widths, strict=True):
            column.append(planes[at : at + w].T)
            at += w
    whole = [np.ascontiguousarray(np.concatenate(c)) for c in out]
    return tuple(c if k.startswith("V") else c.view(k)[:, 0] for c, k in zip(whole, kinds, strict=True))


def _pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors as a float32 scale and 16-bit numbers."""
    scale = np.abs(x).max(1, keepdims=True).astype(np.float32) / 32767
    q = np.rint(x / scale).astype(np.int16)
    return np.concatenate([scale.view(np.uint8), q.view(np.uint8)], 1)


def _unpack(b: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(b[:, :4]).view(np.float32)
    return np.ascontiguousarray(b[:, 4:]).view(np.int16).astype(np.float32) * scale


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = batch.column(2)
        lengths = np.diff(np.frombuffer(vec.buffers()[1], np.int32, len(vec) + 1, vec.offset * 4)) if len(vec) else np.zeros(0, int)
        valid = vec.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids, space = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[valid]):
            at = np.flatnonzero(valid & (lengths == dim))
            if dim == 0:
                continue
            flat = vec.take(pa.array(at)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            x = x / np.where((top := np.abs(x).max(1, keepdims=True)) > 0, top, 1)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            at, x = at[ok], x[ok] / norm[ok, None]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(space[at].astype(np.int64) * DIMS + dim), _binary(_pack(x))], ["nid", "sp", "vec"])


def pack_vectors(df: DataFrame, id_col: str, vec_col: str, space_col: str | None = None) -> DataFrame:
    """nid, sp, vec of every usable vector."""
    space = F.col(space_col).cast("long") if space_col else F.lit(0).cast("long")
    return df.select(F.col(id_col).cast("long").alias("nid"), space.alias("s"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_pack_batches, "nid long, sp long, vec binary")


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[b : b + 8192] @ c.T).argmax(1) for b in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _direction(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=dim).astype(np.float32)


def fit_cells(packed: DataFrame, n: int, labels: list[int], seed: int = 7) -> dict[int, tuple]:
    """Pivots of each space from a sample of at most PIVOT_SAMPLE rows; crowded cells are cut along a projection.

    Gives, by space: pivots, first sub-cell of each pivot, the cuts of each pivot, the part of each sub-cell, the first
    sub-cell of the space, and how much nearer its own part may be to a vector that visits another (a fifth of the sample could).
    """
    every = max(1, n // (PIVOT_SAMPLE // 2))
    rows = packed.where(F.pmod(F.xxhash64("nid"), F.lit(every)) == 0).limit(PIVOT_SAMPLE).toPandas()
    cells: dict[int, tuple] = {}
    first, filled = 0, 0.0
    weight = n / max(1, len(rows))
    for sp, own in rows.groupby("sp"):
        x = _unpack(np.frombuffer(b"".join(own["vec"]), np.uint8).reshape(len(own), -1))
        want = int(np.clip(2 ** np.round(np.log2(max(1, len(x) * weight / ROWS_PER_PIVOT))), 1, MAX_PIVOTS))
        pivots = _kmeans(x, min(want, max(1, len(x) // 8)), 6, seed)
        groups = _kmeans(pivots, max(1, len(pivots) // 16), 8, seed)
        order = np.argsort((pivots @ groups.T).argmax(1), kind="stable")  # pivots of one group lie side by side
        pivots = pivots[order]
        near, along = (x @ pivots.T).argmax(1), x @ _direction(x.shape[1])
        starts, cuts, home = [], [], []
        for p in range(len(pivots)):
            mine = np.sort(along[near == p])
            pieces = max(1, round(len(mine) * weight / (CELL_ROWS)))
            starts.append(first + len(home))
            cuts.append(np.quantile(mine, np.arange(1, pieces) / pieces) if pieces > 1 else np.zeros(0))
            for _ in range(pieces):
                home.append(labels[int(filled * len(labels) / n) % len(labels)])
                filled += len(mine) * weight / pieces
        fitted = (pivots, np.array(starts), cuts, np.array(home), first)
        lead = _parts_of(x, fitted)[2]
        cells[int(sp)] = (*fitted, float(np.quantile(lead[np.isfinite(lead)], 0.2)) if np.isfinite(lead).any() else 0.0)
        first += len(home)
    return cells


def _parts_of(x: np.ndarray, fitted: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of each vector, the next one, and how much nearer the first is (infinite if there is no other)."""
    pivots, starts, cuts, part_of, first = fitted[:5]
    m = min(4, len(pivots))
    cell, near_sims = np.empty((len(x), m), np.int64), np.empty((len(x), m), np.float32)
    along = x @ _direction(x.shape[1])
    for b in range(0, len(x), 4096):
        sims = x[b : b + 4096] @ pivots.T
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), 1), 1)
        cell[b : b + 4096], near_sims[b : b + 4096] = starts[near], np.take_along_axis(sims, near, 1)
    for p in {int(p) for p in np.flatnonzero([len(c) for c in cuts])}:
        hit = cell == starts[p]
        cell[hit] += np.searchsorted(cuts[p], np.broadcast_to(along[:, None], cell.shape)[hit])
    where = part_of[cell - first]
    other = (where != where[:, :1]).argmax(1)
    lead = np.where(other > 0, near_sims[:, 0] - np.take_along_axis(near_sims, other[:, None], 1)[:, 0], np.inf)
    return where[:, 0], np.take_along_axis(where, other[:, None], 1)[:, 0], lead


def _assigner(cells: dict[int, tuple], labels: list[int]):
    """The part each vector lives in (of its nearest pivot), and the next one, which those near the border visit."""

    def place(t: pa.Table) -> Iterator[pa.RecordBatch]:
        spaces, ids, vec = t["sp"].to_numpy(), t["nid"].to_numpy(), t["vec"]
        for sp in np.unique(spaces):
            at = np.flatnonzero(spaces == sp)
            raw = _bytes(vec.take(pa.array(at)), 4 + 2 * int(sp % DIMS))
            if int(sp) in cells:
                home, visit, lead = _parts_of(_unpack(raw), cells[int(sp)])
                away = np.flatnonzero(lead <= cells[int(sp)][5])
            else:  # a space the sample missed is small
                home = visit = np.full(len(at), labels[int(sp) % len(labels)])
                away = np.zeros(0, np.int64)
            yield from _bundles(FAR, 0, sp, visit[away], np.zeros(len(away)), ids[at[away]], home[away].astype(np.int32), np.full(len(away), -2, np.float32), raw[away])
            yield from _bundles(NODE, 0, sp, home, np.zeros(len(at)), ids[at], raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUNDLED:
                yield from place(pa.Table.from_batches(held))
                held = []
        if held:
            yield from place(pa.Table.from_batches(held))

    return run


# Rows that meet in a part: its nodes; and bundles (the nodes too, before round 1) of vectors of nodes that live elsewhere; of edges
# that reach its nodes from there; of finds of other parts for its nodes; and of nodes whose vectors another part (lives)
# shall ship. A part keeps what vectors came (held), says to their homes which it has, and gets of those only the cosine
# of their last neighbour when it asks again (known). at is the part that wrote the row, home the one that reads it.
STATE = "at int, kind byte, home int, nid long, sp long, lives int, kth float, source long, near binary, vec binary"
ARROW_STATE = pa.schema([("at", pa.int32()), ("kind", pa.int8()), ("home", pa.int32()), ("nid", pa.int64()), ("sp", pa.int64()), ("lives", pa.int32()), ("kth", pa.float32()), ("source", pa.int64()), ("near", pa.binary()), ("vec", pa.binary())])
NODE, FAR, BACK, FIND, WANT = 0, 1, 2, 3, 4
QUERY, HELD, HAVE, KNOWN = 5, 6, 7, 8


def _rows(kind: int, home, nid, sp, lives=None, kth=None, source=None, near: pa.Array | None = None, vec: pa.Array | None = None, at: int = 0) -> pa.RecordBatch:
    n = len(nid)
    arrays = [np.full(n, at, np.int32), np.full(n, kind, np.int8), np.asarray(home, np.int32), np.asarray(nid, np.int64), np.asarray(sp, np.int64)]
    arrays += [np.asarray(home if lives is None else lives, np.int32), np.full(n, -2, np.float32) if kth is None else np.asarray(kth, np.float32), np.zeros(n, np.int64) if source is None else np.asarray(source, np.int64)]
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), none if near is None else near, none if vec is None else vec], [c.split()[0] for c in STATE.split(", ")])


def _lists(ids: np.ndarray, homes: np.ndarray, sims: np.ndarray, new: np.ndarray) -> pa.Array:
    """Ids, parts, and cosines (2 added where the edge is new) of equally long lists."""
    cols = [np.ascontiguousarray(ids, np.int64), np.ascontiguousarray(homes, np.int32), np.ascontiguousarray(np.where(new, sims + 4, sims), np.float32)]
    return _binary(np.concatenate([c.view(np.uint8) for c in cols], 1))


def _unlist(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _bytes(column, 16 * LIST)
    ids, homes, sims = (np.ascontiguousarray(raw[:, a * LIST : b * LIST]).view(t) for a, b, t in ((0, 8, np.int64), (8, 12, np.int32), (12, 16, np.float32)))
    new = sims > 2
    return ids, homes, np.where(new, sims - 4, sims), new


def _bundles(kind: int, at: int, sp: int, to: np.ndarray, by: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of numbers, packed into one row for each pair of a reading part and a shipping part."""
    if not len(to):
        return
    order = np.lexsort((by, to))
    to, by, columns = to[order], by[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (by[1:] != by[:-1])])
    packed = pa.array([_squeeze(*(c[a:b] for c in columns)) for a, b in zip(cuts, np.r_[cuts[1:], len(to)], strict=True)], pa.binary())
    yield _rows(kind, to[cuts], np.zeros(len(cuts)), np.full(len(cuts), sp), lives=by[cuts], near=packed, at=at)


# A place in a list is sorted as one 64-bit number: node (20 bits), and then neighbour, newness and cosine.
PLACES, SIM_TOP = 1 << 20, (1 << 23) - 1
U64 = np.uint64


def best_lists(node: np.ndarray, other: np.ndarray, sims: np.ndarray, new: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, cosines, newness) of the k best distinct neighbours of each node 0..n-1, best first, ties to the
    smaller place; an edge given twice is new only if it is in both; padding is -1 with cosine -2."""
    q = np.clip((sims.astype(np.float64) + 1) * (SIM_TOP / 2), 0, SIM_TOP).astype(U64)
    by_edge = node.astype(U64) << U64(44) | other.astype(U64) << U64(24) | new.astype(U64) << U64(23) | q
    by_edge.sort()
    first = np.ones(len(by_edge), bool)
    first[1:] = by_edge[1:] >> U64(24) != by_edge[:-1] >> U64(24)
    e = by_edge[first]
    worse = U64(SIM_TOP) - (e & U64(SIM_TOP))
    by_sim = e >> U64(44) << U64(44) | worse << U64(21) | (e >> U64(24) & U64(PLACES - 1)) << U64(1) | e >> U64(23) & U64(1)
    by_sim.sort()
    who = (by_sim >> U64(44)).astype(np.int64)
    rank = np.arange(len(who)) - np.searchsorted(who, np.arange(n))[who]
    by_sim, who, rank = by_sim[rank < k], who[rank < k], rank[rank < k]
    near, best, fresh = np.full((n, k), -1, np.int32), np.full((n, k), -2, np.float32), np.zeros((n, k), bool)
    near[who, rank] = (by_sim >> U64(1) & U64(PLACES - 1)).astype(np.int32)
    best[who, rank] = (U64(SIM_TOP) - (by_sim >> U64(21) & U64(SIM_TOP))).astype(np.float64) * (2 / SIM_TOP) - 1
    fresh[who, rank] = (by_sim & U64(1)).astype(bool)
    return near, best, fresh


def _some(src: np.ndarray, dst: np.ndarray, n: int, most: int, rng: np.random.Generator) -> np.ndarray:
    """Of the sources of each node 0..n-1, at random, as many as asked for."""
    out = np.full((n, most), -1, np.int32)
    key = dst.astype(U64) << U64(44) | rng.integers(0, 1 << 24, len(dst)).astype(U64) << U64(20) | src.astype(U64)
    key.sort()
    d = (key >> U64(44)).astype(np.int64)
    rank = np.arange(len(d)) - np.searchsorted(d, np.arange(n))[d]
    out[d[rank < most], rank[rank < most]] = (key[rank < most] & U64(PLACES - 1)).astype(np.int32)
    return out


def _pick(near: np.ndarray, which: np.ndarray, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At random so many of the marked places of each list: (neighbours, marks of the places taken)."""
    order = np.argsort(np.where(which, rng.random(near.shape, np.float32), 2), 1)[:, :most]
    taken = np.zeros_like(which)
    np.put_along_axis(taken, order, np.take_along_axis(which, order, 1), 1)
    return np.where(np.take_along_axis(which, order, 1), np.take_along_axis(near, order, 1), -1), taken


def descend(x: np.ndarray, near: np.ndarray, sims: np.ndarray, new: np.ndarray, far_kth: np.ndarray, back: tuple, rng: np.random.Generator) -> tuple:
    """NN-descent among the vectors x of one part. The first n of them have lists (near: places in x, beyond it where the
    vector is not here, -1 where there is none); the others live elsewhere, with the cosine of their last neighbour in
    far_kth. back: (source, target, new) of edges that come from elsewhere.

    Each step compares a sample of the new neighbours of each node with each other and with a sample of its old ones, and
    every find better than the last place of a list enters it. Gives the lists, and (node, neighbour, cosine) of the finds
    for the others. Ends when at most DELTA of the places, of those that can be compared here, are new.
    """
    n, k, here = *near.shape, len(x)
    source, target, unseen = (np.array(c) for c in back)
    kth = np.concatenate([sims[:, -1], far_kth]).astype(np.float32)
    finds = []
    pairs = np.concatenate([np.triu(np.ones((2 * SAMPLE, 2 * SAMPLE), bool), 1), np.ones((2 * SAMPLE, 2 * SAMPLE), bool)], 1)
    while True:
        new_ahead, taken = _pick(near, new & (near >= 0) & (near < here), SAMPLE, rng)
        old_ahead, _ = _pick(near, ~new & (near >= 0) & (near < here), SAMPLE, rng)
        new &= ~taken
        behind = []
        for ahead, edges in ((new_ahead, unseen), (old_ahead, ~unseen)):
            src, dst = np.repeat(np.arange(n), ahead.shape[1]), ahead.ravel()
            listed = (dst >= 0) & (dst < n)
            behind.append(_some(np.concatenate([src[listed], source[edges]]), np.concatenate([dst[listed], target[edges]]), n, SAMPLE, rng))
        unseen = np.zeros(len(unseen), bool)
        around = np.concatenate([new_ahead, behind[0], old_ahead, behind[1]], 1)
        u, w, s = [], [], []
        active = np.flatnonzero((around[:, : 2 * SAMPLE] >= 0).any(1))
        for b in range(0, len(active), 1024):
            group = around[active[b : b + 1024]]
            v = x[group]
            cosines = v[:, : 2 * SAMPLE] @ v.transpose(0, 2, 1)
            least = np.where(group < 0, np.float32(9), kth[group])
            least = np.where(pairs & (group >= 0)[:, None, :] & (group >= 0)[:, : 2 * SAMPLE, None], np.minimum(least[:, : 2 * SAMPLE, None], least[:, None, :]), np.float32(9))
            at, i, j = np.nonzero(cosines > least)
            u.append(group[at, i]), w.append(group[at, j]), s.append(cosines[at, i, j])
        if not u:
            break
        u, w, s = np.concatenate([*u, *w]), np.concatenate([*w, *u]), np.concatenate([*s, *s])
        better = (u != w) & (s > kth[u])
        u, w, s = u[better], w[better], s[better]
        away = u >= n
        finds.append((u[away] - n, w[away], s[away]))
        full = near.ravel() >= 0
        u = np.concatenate([np.repeat(np.arange(n), k)[full], u[~away]])
        near, sims, new = best_lists(u, np.concatenate([near.ravel()[full], w[~away]]), np.concatenate([sims.ravel()[full], s[~away]]), np.concatenate([new.ravel()[full], np.ones((~away).sum(), bool)]), n, k)
        kth[:n] = sims[:, -1]
        if (new & (near >= 0) & (near < here)).sum() <= DELTA * n * k:
            break
    return near, sims, new, finds


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct row of the columns."""
    o = np.lexsort(columns[::-1])
    first = np.ones(len(o), bool)
    first[1:] = np.any([c[o][1:] != c[o][:-1] for c in columns], axis=0)
    return o[first]


def _first_lists(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(node, neighbour) of the lists that a part starts from: two nodes at random, and those that lie beside a node in
    the order of its signs along random directions."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node = np.repeat(np.arange(n), 2)
    other = (node + 1 + rng.integers(0, n - 1, len(node))) % n
    pairs = [(node, other), (other, node)]  # both ends of a pair consider it, as in all later comparisons
    for _ in range(PROJECTIONS):
        signs = x @ rng.normal(size=(x.shape[1], 18)).astype(np.float32) > 0
        order = np.argsort(signs @ (1 << np.arange(18)), kind="stable")
        pairs += [(order, np.roll(order, 1)), (order, np.roll(order, -1))]
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))


def _unknown(finds: tuple, near: np.ndarray, back: tuple, n: int) -> tuple:
    """(node, neighbour, cosine) of the finds for nodes that live elsewhere (places from n on, counted from 0) without those
    their homes have weighed before: a pair that is an edge at either end was weighed at both when it became one."""
    node, other, cosine = finds
    i, j = np.nonzero(near >= n)
    source, target = back[0], back[1]
    known = np.concatenate([(near[i, j] - n) * np.int64(PLACES) + i, (source[source >= n] - n) * np.int64(PLACES) + target[source >= n]])
    left = ~np.isin(node * np.int64(PLACES) + other, known)
    return node[left], other[left], cosine[left]


def _part_round(number: int, join: bool, seed: int = 11):
    """One round in one part. Round 1 starts from random lists; later ones fold in what other parts found. The part then
    compares (if join) and says which vectors and edges go where."""

    def one_space(t: pa.Table, home: int, sp: int) -> Iterator[pa.RecordBatch]:
        kind, nid = t["kind"].to_numpy(), t["nid"].to_numpy()
        rng = np.random.default_rng([seed, number, home])

        def bundled(kind_of: int, *kinds: str) -> tuple[np.ndarray, ...]:
            return _unsqueeze(t["near"].take(pa.array(np.flatnonzero(kind == kind_of))).to_pylist(), *kinds)

        width = 4 + 2 * int(sp % DIMS)
        if number == 1:
            own, raw = bundled(NODE, "i8", f"V{width}")
        else:
            held = np.flatnonzero(kind == NODE)
            own, raw = nid[held], _bytes(t["vec"].take(pa.array(held)), width)
        nodes = _distinct(own)
        own, raw, n = own[nodes], raw[nodes], len(nodes)
        if not n:
            return
        far_id, far_home, far_kth, far_raw = bundled(FAR, "i8", "i4", "f4", f"V{width}")
        held_id, held_home, _, held_raw = bundled(HELD, "i8", "i4", "f4", f"V{width}")
        known, known_kth = bundled(KNOWN, "i8", "f4")
        o = np.argsort(held_id, kind="stable")
        o = o[np.searchsorted(held_id[o], known)]
        has_id, has_home = np.concatenate([held_id, far_id]), np.concatenate([held_home, far_home])
        far_id, far_home, far_kth = np.concatenate([far_id, known]), np.concatenate([far_home, held_home[o]]), np.concatenate([far_kth, known_kth])
        far_raw = np.concatenate([far_raw, held_raw[o]])
        o = _distinct(far_id)
        o = o[~np.isin(far_id[o], own)]
        far_id, far_home, far_kth = far_id[o], far_home[o], far_kth[o]
        x = np.concatenate([_unpack(raw), _unpack(far_raw[o])])
        # places: own nodes, vectors shipped here, and last the names of nodes whose vectors are not here
        names, homes = np.concatenate([own, far_id]), np.concatenate([np.full(n, home), far_home]).astype(np.int32)
        order = np.argsort(names)

        def place_of(ids: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names[order], ids), len(order) - 1)
            return np.where(names[order][at] == ids, order[at], -1)

        if number == 1:
            listed = len(x)
            node, place = _first_lists(x, rng)
            cosines = np.concatenate([np.einsum("nd,nd->n", x[node[b : b + 65_536]], x[place[b : b + 65_536]]) for b in range(0, len(node) + 1, 65_536)])
            near, sims, new = best_lists(node, place, cosines, np.ones(len(node), bool), listed, LIST)
            edges = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            before = np.full((listed, 1), -1)
        else:
            listed = n
            ids, where, cosines, fresh = (c.ravel() for c in _unlist(t["near"].take(pa.array(held[nodes]))))
            real = cosines > -2
            mine = int(real.sum())
            who, found_ids, found_where, found_cosines = bundled(FIND, "i8", "i8", "i4", "f4")
            node = np.concatenate([np.repeat(np.arange(n), LIST)[real], np.searchsorted(own, who)])
            ids, where, cosines = np.concatenate([ids[real], found_ids]), np.concatenate([where[real], found_where]), np.concatenate([cosines[real], found_cosines])
            fresh = np.concatenate([fresh[real], np.ones(len(who), bool)])
            place = place_of(ids)
            more, at = np.unique(ids[place < 0], return_inverse=True)
            place[place < 0] = len(names) + at
            names, homes = np.concatenate([names, more]), np.concatenate([homes, np.zeros(len(more), np.int32)])
            homes[place] = where
            before = np.full(n * LIST, -1)
            before[real] = place[:mine]
            before = before.reshape(n, LIST)
            near, sims, new = best_lists(node, place, cosines, fresh, n, LIST)
            target, source = bundled(BACK, "i8", "i8")
            target, source = np.searchsorted(own, target), place_of(source)
            edges = (source[source >= 0], target[source >= 0], np.ones((source >= 0).sum(), bool))
        if len(names) >= PLACES:
            raise ValueError(f"part {home} names {len(names)} vectors; more parts are needed")
        finds = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        begun = near[:n] if number > 1 else np.zeros((0, LIST), np.int32)
        if join:
            near, sims, new, found = descend(x, near, sims, new, far_kth[listed - n :], edges, rng)
            finds += found
        if listed > n:  # the lists that visitors made here go home
            i, j = np.nonzero(near[n:] >= 0)
            finds.append((i, near[n:][i, j], sims[n:][i, j]))
            near, sims, new = near[:n], sims[:n], new[:n]
        changed = (near >= 0) & ~(near[:, :, None] == before[:n, None, :]).any(2)
        got, got_home = np.where(near >= 0, names[near], -1), np.where(near >= 0, homes[near], -1)
        yield _rows(NODE, np.full(n, home), own, np.full(n, sp), kth=sims[:, -1], source=changed.sum(1), near=_lists(got, got_home, sims, new), vec=_binary(raw), at=home)
        # only edges that are new go over the borders; pairs of a new and an old neighbour meet where both are at hand
        i, j = np.nonzero((near >= 0) & (got_home != home) & (new | changed))
        yield from _bundles(BACK, home, sp, got_home[i, j], np.full(len(i), home), got[i, j], own[i])
        wants = [(np.full(len(i), home), got_home[i, j], got[i, j]), (got_home[i, j], np.full(len(i), home), own[i])]
        node, other, cosine = _unknown(tuple(np.concatenate(c) for c in zip(*finds, strict=True)), begun, edges, n)
        best, cosine, _ = best_lists(node, other, cosine, np.ones(len(node), bool), len(far_id), LIST)
        i, j = np.nonzero(best >= 0)
        yield from _bundles(FIND, home, sp, far_home[i], np.full(len(i), home), far_id[i], names[best[i, j]], homes[best[i, j]], cosine[i, j])
        asks, ships, ids = (np.concatenate(c) for c in zip(*wants, strict=True))
        o = _distinct(asks, ids)
        yield from _bundles(WANT, home, sp, asks[o], ships[o], ids[o])
        came = np.flatnonzero(kind == FAR)
        yield _rows(HELD, np.full(len(came), home), np.zeros(len(came)), np.full(len(came), sp), near=t["near"].take(pa.array(came)).combine_chunks(), at=home)
        o = _distinct(has_id)
        yield from _bundles(HAVE, home, sp, np.full(len(o), home), has_home[o], has_id[o])

    def first(t: pa.Table) -> pa.Table:
        t = t.cast(ARROW_STATE).combine_chunks()
        out = []
        for home, sp in sorted(set(zip(t["home"].to_pylist(), t["sp"].to_pylist(), strict=True))):
            out += one_space(t.filter(pc.and_(pc.equal(t["home"], home), pc.equal(t["sp"], sp))).combine_chunks(), home, sp)
        return pa.Table.from_batches(out, ARROW_STATE)

    def later(nodes: pa.Table, sent: pa.Table) -> pa.Table:
        return first(pa.concat_tables([nodes.cast(ARROW_STATE), sent.cast(ARROW_STATE)]))

    return first if number == 1 else later


def _shipper(nodes: pa.Table, wants: pa.Table) -> pa.Table:
    """The vectors of one part that go to other parts, once to each: both ends of an edge may ask for the same, and a part
    that has a vector from an earlier round gets only the cosine of its last neighbour."""
    nid, kth, spaces, vec = nodes["nid"].to_numpy(), nodes["kth"].to_numpy(), nodes["sp"].to_numpy(), nodes["vec"]
    asked: dict[tuple[int, int], list[bytes]] = {}
    had: dict[tuple[int, int], list[bytes]] = {}
    for kind, asks, sp, packed in zip(*(wants[c].to_pylist() for c in ("kind", "home", "sp", "near")), strict=True):
        (asked if kind == WANT else had).setdefault((asks, sp), []).append(packed)
    out = []
    for (asks, sp), packed in sorted(asked.items()):
        own = np.flatnonzero(spaces == sp)
        row = own[np.isin(nid[own], _unsqueeze(packed, "i8")[0])]
        row = row[np.argsort(nid[row])]
        has = np.isin(nid[row], _unsqueeze(had.get((asks, sp), []), "i8")[0])
        known, row = row[has], row[~has]
        out += _bundles(KNOWN, 0, sp, np.full(len(known), asks), np.zeros(len(known)), nid[known], kth[known])
        raw = _bytes(vec.take(pa.array(row)), 4 + 2 * int(sp % DIMS))
        out += _bundles(FAR, 0, sp, np.full(len(row), asks), np.zeros(len(row)), nid[row], nodes["at"].to_numpy()[row], kth[row], raw)
    return pa.Table.from_batches(out, ARROW_STATE)


def _part_names(spark: SparkSession, parts: int) -> list[int]:
    """Numbers for the parts that hashing spreads over as many partitions, one a partition."""
    tried, names = 16 * parts, {}
    while len(names) < parts:
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
        names = {r["b"]: r["i"] for r in spark.range(tried).groupBy(bucket.alias("b")).agg(F.min("id").alias("i")).collect()}  # a row a part
        tried *= 4
    return [int(names[b]) for b in range(parts)]


class _Rounds:
    """The state between rounds, as a table bucketed by part: a round reads its nodes where they lie, and only what parts
    send each other is shuffled. Vectors that came to a part are written once and stay; the rest of a round goes when the
    next is written."""

    def __init__(self, spark: SparkSession, parts: int) -> None:
        self.spark, self.parts, self.number = spark, parts, 0
        self.path = scratch_path(spark, "graph")
        self.name = "tomeline_" + self.path.rsplit("-", 1)[-1]

    def write(self, df: DataFrame) -> DataFrame:
        last, self.number = self.number, self.number + 1
        rows = df.withColumn("round", F.lit(self.number))
        rows.write.mode("append").partitionBy("round", "kind").bucketBy(self.parts, "at").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.forget(last, NODE, FIND, BACK, WANT, HAVE)
        self.spark.sql(f"REFRESH TABLE {self.name}")
        return self.spark.table(self.name).where((F.col("round") == self.number) | (F.col("kind") == HELD))

    def forget(self, number: int, *kinds: int) -> None:
        for kind in kinds:
            drop_path(self.spark, f"{self.path}/round={number}/kind={kind}")

    def end(self) -> None:
        """Leaves the nodes of the last round."""
        self.spark.sql(f"DROP TABLE {self.name}")
        for number in range(1, self.number + 1):
            self.forget(number, FIND, BACK, WANT, HAVE, HELD)


def neighbour_graph(packed: DataFrame, rounds: int | None = None, keep_vectors: bool = False) -> tuple[DataFrame, DataFrame]:
    """NN-descent. Gives (graph, copies).

    graph: home, nid, sp, near, [vec] of one row for each distinct vector; near packs LIST ids, parts and cosines.
    copies: nid, rep of every row whose vector comes more than once within its space.
    rounds (for measuring) stops after so many rounds; else they go on until the graph is quiet.
    """
    spark = packed.sparkSession
    packed = cut(packed, "vectors")
    keys = packed.select("nid", "sp", F.xxhash64("sp", "vec").alias("h1"), F.xxhash64("vec", "sp", F.lit(1)).alias("h2"))
    again = cut(keys.groupBy("h1").count().where("count > 1").select("h1"), "again")  # few, as a rule: the keys need not be shuffled again
    likely = cut(keys.join(again, "h1"), "likely")
    groups = likely.groupBy("h1", "h2").agg(F.min("nid").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = cut(likely.join(groups, ["h1", "h2"]).select("nid", "rep").distinct(), "copies")
    single = packed.join(copies.where("nid <> rep").select("nid"), "nid", "left_anti")
    n = max(1, packed.count())
    parts = max(1, min(LEAST_PARTS, n // 2_000), -(-n // PART_ROWS))
    # the rounds run in a session of their own whose shuffles have as many partitions as there are parts
    work = spark.newSession()
    work.conf.set("spark.sql.shuffle.partitions", parts)
    work.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    work.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")  # folders are listed anew after each round
    names = _part_names(work, parts)
    placed = cut(single.mapInArrow(_assigner(fit_cells(packed, n, names), names), STATE), "placed")
    drop(packed)
    rounds_of, number = _Rounds(work, parts), 1
    arrived = work.read.schema(placed.schema).parquet(placed.cut_path)
    state = rounds_of.write(arrived.groupBy("home").applyInArrow(_part_round(number, rounds != 0), STATE))
    drop(placed)
    while True:
        nodes = state.where(F.col("kind") == NODE)
        changed = nodes.agg(F.coalesce(F.sum("source"), F.lit(0))).first()[0]
        if number == rounds or rounds == 0 or changed <= DELTA * LIST * n:
            break
        number += 1
        told = state.select(*(F.col(c).alias(c) for c in ARROW_STATE.names))  # else Spark may drop columns that both sides of a cogroup share
        wants = told.where(F.col("kind").isin(WANT, HAVE))
        shipped = nodes.select("at", "nid", "sp", "kth", "vec").groupBy("at").cogroup(wants.select("kind", "home", "sp", "lives", "near").groupBy("lives")).applyInArrow(_shipper, STATE)
        sent = told.where(F.col("kind").isin(FIND, BACK)).unionByName(shipped)
        kept = state.where(F.col("kind").isin(NODE, HELD)).select(ARROW_STATE.names)
        state = rounds_of.write(kept.groupBy("at").cogroup(sent.groupBy("home")).applyInArrow(_part_round(number, True), STATE))
    rounds_of.end()
    graph = spark.read.schema(STATE).parquet(rounds_of.path).where(F.col("kind") == NODE)
    return graph.select("home", "nid", "sp", "near", *(["vec"] if keep_vectors else [])), copies


def _edge_batches(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, sims, _ = _unlist(batch.column(1))
            nid = np.repeat(batch.column(0).to_numpy(), LIST)
            ok = sims.ravel() >= max(floor, -1.5)
            yield pa.RecordBatch.from_arrays([pa.array(nid[ok]), pa.array(ids.ravel()[ok]), pa.array(np.minimum(sims.ravel()[ok], 1.0).astype(np.float64))], ["a", "b", "sim"])

    return run


def _heads(copies: DataFrame, k: int) -> DataFrame:
    """rep, head: the k + 1 copies of smallest id, of which k are left for one that is itself among them."""
    return copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("nid"))).where(F.col("r") <= k + 1).select("rep", F.col("nid").alias("head"))


def nearest(graph: DataFrame, copies: DataFrame, k: int = 10, floor: float = -1.0) -> DataFrame:
    """id, other, cosine, rank: the k nearest of every vector whose cosine is at least floor, copies included.

    A vector with more than k copies takes the k of smallest id; every copy gets its own list, so rows grow with
    copies, not with their pairs.
    """
    edges = graph.select("nid", "near").mapInArrow(_edge_batches(floor), "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    heads = _heads(copies, k)
    spread = edges.join(heads, edges["b"] == heads["rep"], "left").select("a", F.coalesce("head", "b").alias("b"), "sim")
    spread = spread.unionByName(heads.select(F.col("rep").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("sim")))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    short = spread.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    own = short.join(copies, short["a"] == copies["rep"], "left").select(F.coalesce("nid", "a").alias("a"), "b", "sim").where("a <> b")
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("sim").alias("cosine"), "rank")


WALKED = ["qid", "nid", "sim", "via"]


def _walker(beam: int, entries: int):
    """Greedy search of each query through the nodes of one part, from its doors (of a query without, from nodes spread
    over the part); gives the beam, and the neighbours of its nodes that lie elsewhere with the cosine of the best node
    that leads there (via)."""

    def walk(q: np.ndarray, x: np.ndarray, near: np.ndarray, doors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = np.where(doors >= 0, np.einsum("qd,qcd->qc", q, x[doors]) if len(doors) > 1 else q @ x[doors[0]].T, -2).astype(np.float32)
        width = min(beam, doors.shape[1])
        pick = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        at, best = np.take_along_axis(np.broadcast_to(doors, sims.shape), pick, 1), np.take_along_axis(sims, pick, 1)
        while True:
            around = np.concatenate([at, near[at].reshape(len(q), -1)], 1)
            around.sort(axis=1)
            fresh = np.ones(around.shape, bool)
            fresh[:, 1:] = around[:, 1:] != around[:, :-1]
            fresh &= around >= 0
            s = np.where(fresh, np.einsum("qd,qcd->qc", q, x[around]), -2).astype(np.float32)
            width = min(beam, s.shape[1])
            pick = np.argpartition(-s, width - 1, axis=1)[:, :width]
            now, s = np.take_along_axis(around, pick, 1), np.take_along_axis(s, pick, 1)
            done = now.shape == at.shape and float(s.sum()) <= float(best.sum()) + 1e-6
            at, best = now, s
            if done:
                break
        return at, best

    def one(t: pa.Table, sp: int) -> Iterator[pa.RecordBatch]:
        kind, nid = t["kind"].to_numpy(), t["nid"].to_numpy()
        width = 4 + 2 * int(sp % DIMS)
        node, asked = np.flatnonzero(kind == NODE), np.flatnonzero(kind == QUERY)
        if not len(node) or not len(asked):
            return
        own = nid[node]
        order = np.argsort(own)
        own, node = own[order], node[order]
        x = _unpack(_bytes(t["vec"].take(pa.array(node)), width))
        ids, _, sims, _ = _unlist(t["near"].take(pa.array(node)))
        place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        local = np.where((own[place] == ids) & (sims > -2), place, -1)
        spread = np.unique(np.linspace(0, len(own) - 1, min(entries, len(own))).astype(int))[None]
        sent = t["doors"].is_valid().to_numpy()[asked]
        groups = [(asked[~sent], False), (asked[sent], True)]
        for some, has_doors in ((g[b : b + 512], f) for g, f in groups for b in range(0, len(g), 512)):
            doors = spread
            if has_doors:
                given = t["doors"].take(pa.array(some)).to_pylist()
                doors = np.full((len(some), max(map(len, given))), -1, np.int64)
                for i, ids_of in enumerate(given):
                    doors[i, : len(ids_of)] = np.searchsorted(own, ids_of)
                doors = np.concatenate([doors, np.full((1, doors.shape[1]), -1, np.int64)])  # never one row, which stands for all
            q = _unpack(_bytes(t["vec"].take(pa.array(some)), width))
            at, best = walk(np.concatenate([q, q[:1]]) if has_doors else q, x, local, doors)
            at, best = at[: len(some)], best[: len(some)]
            seen = best > -1.5
            rows = np.broadcast_to(np.arange(len(some))[:, None], at.shape)
            qid = nid[some]
            yield pa.RecordBatch.from_arrays([pa.array(qid[rows[seen]]), pa.array(own[at[seen]]), pa.array(best[seen].astype(np.float64)), pa.nulls(int(seen.sum()), pa.float64())], WALKED)
            r, c, e = np.nonzero((local[at] < 0) & (sims[at] > -2) & seen[:, :, None])
            far, via = ids[at[r, c], e], best[r, c].astype(np.float64)
            o = np.lexsort((-via, far, r))
            r, far, via = r[o], far[o], via[o]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (far[1:] != far[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(qid[r[first]]), pa.array(far[first]), pa.nulls(int(first.sum()), pa.float64()), pa.array(via[first])], WALKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        homes, spaces = t["home"].to_numpy(), t["sp"].to_numpy()
        for home, sp in sorted(set(zip(homes.tolist(), spaces.tolist(), strict=True))):
            yield from one(t.filter(pa.array((homes == home) & (spaces == sp))).combine_chunks(), sp)

    return run


def search(queries: DataFrame, graph: DataFrame, homes: DataFrame, k: int = 10, beam: int = 48, entries: int = 512) -> DataFrame:
    """qid, nid, sim, rank by greedy search on a graph built with keep_vectors.

    queries(nid, sp, vec), homes(nid, home): the part where each query starts. A walk stays in one part; then each query
    goes to the parts of the nodes that its beam leads to and walks on from them there, round by round, until no list of
    k gets better or nothing is left to visit. Copies of a vector stand for their smallest id.
    """
    asked = cut(queries.join(homes, "nid").select("home", "nid", "sp", "vec"), "asked")
    rows = graph.select(F.lit(NODE).cast("byte").alias("kind"), "home", "nid", "sp", "near", "vec", F.lit(None).cast("array<long>").alias("doors"))
    sent = asked.select("home", "nid", "sp", "vec", F.lit(None).cast("array<long>").alias("doors"))
    ordered = Window.partitionBy("qid").orderBy(F.desc("sim"), "nid")
    lists = best = visited = None
    while True:
        both = rows.unionByName(sent.select(F.lit(QUERY).cast("byte").alias("kind"), "home", "nid", "sp", F.lit(None).cast("binary").alias("near"), "vec", "doors"))
        walked = cut(both.repartition("home").mapInArrow(_walker(beam, entries), "qid long, nid long, sim double, via double"), "walked")
        reached = walked.where("sim is not null and qid <> nid").select("qid", "nid", "sim")
        reached = reached if lists is None else reached.unionByName(lists.select("qid", "nid", "sim"))
        lists = cut(reached.groupBy("qid", "nid").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= beam), "lists")
        now = lists.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, F.col("sim") + 2)).alias("sum"), F.when(F.count("*") >= beam, F.min("sim")).otherwise(-2.0).alias("worst"))
        still = now if best is None else now.join(best.withColumnRenamed("sum", "was"), "qid").where("sum > was + 1e-6")
        best = now.select("qid", "sum")
        ahead = walked.where("sim is null").join(still.select("qid", "worst"), "qid").where("via >= worst").select("qid", "nid").distinct()
        ahead = ahead.join(lists.select("qid", "nid"), ["qid", "nid"], "left_anti")
        ahead = cut(ahead if visited is None else ahead.join(visited, ["qid", "nid"], "left_anti"), "ahead")
        if ahead.isEmpty():
            return lists.where(F.col("rank") <= k)
        visited = ahead if visited is None else visited.unionByName(ahead)
        doors = ahead.join(graph.select("nid", "home"), "nid").groupBy("qid", "home").agg(F.collect_list("nid").alias("doors"))
        sent = doors.join(asked.select(F.col("nid").alias("qid"), "sp", "vec"), "qid").select("home", F.col("qid").alias("nid"), "sp", "vec", "doors")


def with_copies(found: DataFrame, queries: DataFrame, copies: DataFrame, k: int = 10) -> DataFrame:
    """qid, nid, sim, rank: the lists of search() with every copy of what they name, and the copies of the query itself."""
    heads = _heads(copies, k)
    spread = found.join(heads, found["nid"] == heads["rep"], "left").select("qid", F.coalesce("head", "nid").alias("nid"), F.least("sim", F.lit(1.0)).alias("sim"))
    own = queries.select("nid").join(copies, "nid").join(heads, "rep").select(F.col("nid").alias("qid"), F.col("head").alias("nid"), F.lit(1.0).alias("sim"))
    best = spread.unionByName(own).where("qid <> nid").groupBy("qid", "nid").agg(F.max("sim").alias("sim"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "nid"))).where(F.col("rank") <= k)
