"""Near-duplicate embeddings through overlapping shards.

1. *Shards.*  Random vectors are pivots, one per ``SHARD`` vectors but at most
   ``PIVOTS``; each vector joins the shards of its ``OVERLAP`` nearest pivots
   (or half as many as the pivots have binary digits, if that is more).  A shard
   of more than ``LARGEST`` vectors is cut again in the same way, by pivots of
   its own, until none is, so what a task or a broadcast holds doesn't grow.
2. *Compare.*  A shard of up to ``COMPARED`` vectors is compared whole, by
   blocked products in single precision.  In a larger one (none is, unless
   ``largest`` is raised) a robust-pruned graph is built: a vector's candidates
   are its nearest neighbours, some random vectors and the shard's medoid,
   pruning (a candidate goes when a chosen neighbour is ``ALPHA`` times closer to
   it than the vector is) leaves ``DEGREE`` of them, reverse edges are added and
   pruned alike, and each vector is searched for greedily from the medoid with a
   list of ``BREADTH``, which then expands every vector found in range.
3. *Once each.*  A link of vectors with several common shards counts in the
   least of them alone, so no link is made twice and none is shuffled to find
   that out.
4. *Further shards.*  Where a vector in range lies in shards that the query
   isn't in, the query is compared there too, shard by shard, until no query
   enters a new one.
5. *Verify.*  Links count if their cosine in double precision is at least
   ``min_cosine``; it is taken where single precision leaves a doubt.
6. *Audit.*  Before the build ``PROBES`` random vectors get a perturbed partner
   each, at a random cosine of at least ``min_cosine``, which is indexed like
   any other vector.  They and their partners are compared with all vectors.
   While the lower confidence bound of the share of these true links that the
   search found is under ``RECALL``, the breadth is doubled, the overlap raised
   by one, and the comparison repeated.  So an audit always has links to
   judge by, and takes one pass over the vectors.  The partners don't show in
   the result.

Equal vectors are one node with a number of rows, so copies cost no search.

The result has a row for each vector: its class, named by the least id of all
vectors that links tie together, and the number of its links.

Defined cases: null ids, null or empty vectors, vectors with a null, NaN or
infinite entry and zero vectors are left out.  Vectors of different length are
never near each other.  Rows that repeat an id and vector are one; an id with
several vectors has a row for each of them.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.runtime import components, cut

MIN_COSINE = 0.9
SHARD = 1024
PIVOTS = 1024
LARGEST = 16384
OVERLAP = 2
DEGREE = 24
CANDIDATES = 48
RANDOM = 12
ALPHA = 1.2
BREADTH = 24
PROBES = 500
RECALL = 0.95
Z = 1.645
#: Vectors of a shard up to which comparing all of them costs less than walking a graph.
COMPARED = 1 << 14
_CHUNK = 256
_ROWS = 1024
_FANOUT = 4
_PAIRS = 1 << 17
#: Vectors of a block where all pairs are compared; a task holds two blocks.
BLOCK = 1 << 15
#: What a cosine in single precision may be off by.
_DOUBT = 1e-5

CELLS = "shard long, node long"
LINKS = "a long, b long, na long, nb long, tree boolean, to long"


def members(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): the rows that count, once each."""
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))) & F.exists("vec", lambda x: F.abs(x) > 1e-150)
    plain = F.transform("vec", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return src.filter(ok).withColumn("vec", plain).distinct()


def nodes(rows: DataFrame) -> DataFrame:
    """(node, vec, n, first_id): the distinct vectors of members() with the number of their rows and the least id."""
    return rows.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).select(F.xxhash64("vec").alias("node"), "vec", "n", "first_id")


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows x length) of a non-empty list column whose rows are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def probes(points: DataFrame, n: int = PROBES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(node, vec, of): perturbed partners of the ``n`` nodes with the least hashes; at most n rows, made on the driver."""
    rows = points.orderBy(F.xxhash64("node", F.lit("probe")), "node").limit(n).select("node", "vec").toArrow().to_pylist()
    rng = np.random.default_rng(11)
    out = []
    for r in rows:
        v = np.array(r["vec"]) / np.abs(r["vec"]).max()
        v /= np.linalg.norm(v)
        side = rng.normal(size=len(v))
        side -= (side @ v) * v
        norm = np.linalg.norm(side)
        cosine = rng.uniform(min_cosine, 1.0)
        if norm > 1e-9:  # else there is no other direction
            out.append((r["node"], (cosine * v + math.sqrt(1 - cosine * cosine) * side / norm).tolist()))
    made = points.sparkSession.createDataFrame(out, "of long, vec array<double>")
    return made.select(F.xxhash64("vec").alias("node"), "vec", "of")


def _nearest(v: np.ndarray, centre: np.ndarray, overlap: int) -> np.ndarray:
    """(rows x overlap) nearest of the pivots, nearest first."""
    near = -(v @ centre.T)
    m = min(overlap, len(centre))
    best = np.argpartition(near, m - 1, axis=1)[:, :m]
    return np.take_along_axis(best, np.take_along_axis(near, best, 1).argsort(axis=1), 1)


def _cells(nodes: np.ndarray, v: np.ndarray, names: np.ndarray, centre: np.ndarray, overlap: int) -> pa.Table:
    best = _nearest(v, centre, overlap)
    return pa.table([pa.array(names[best.ravel()]), pa.array(np.repeat(nodes, best.shape[1]))], names=["shard", "node"])


def assign(points: DataFrame, shard: int = SHARD, overlap: int = OVERLAP, pivots: int = PIVOTS, largest: int = LARGEST) -> DataFrame:
    """CELLS: each vector in its nearest pivots' shards."""
    sizes = {r["dim"]: r["n"] for r in points.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    known = {}
    for dim, n in sizes.items():  # for each length of vectors at most ``pivots``
        m = min(pivots, -(-n // shard))
        m = 1 if n <= largest and m < 2 * overlap else m  # else most shards would hold most vectors
        rows = points.filter(F.size("vec") == dim).orderBy(F.xxhash64("node"), "node").limit(m).select("node", "vec").toArrow()
        known[dim] = rows["node"].to_numpy(), _unit(rows["vec"])
    shared = points.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            dims = np.diff(batch.column("vec").offsets.to_numpy())
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, len(part), _ROWS):
                    piece = part.slice(at, _ROWS)
                    yield from _cells(piece.column("node").to_numpy(), _unit(piece.column("vec")), *shared.value[int(dim)], overlap).to_batches()

    done, level = [], 0
    cells = cut(points.select("node", "vec").mapInArrow(run, CELLS))
    while True:
        level += 1
        large = cut(cells.groupBy("shard").agg(F.count("*").alias("size")).filter(F.col("size") > largest))
        if large.isEmpty():
            done.append(cells)
            break
        done.append(cells.join(large, "shard", "left_anti").select(cells.columns))
        inside = cells.join(large, "shard").join(points.select("node", "vec"), "node")
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        chosen = inside.filter(draw < F.least(F.lit(float(pivots)), F.col("size") / shard) / F.col("size")).select(F.col("shard").alias("home"), F.col("size").alias("of"), F.col("node").alias("pivot"), F.col("vec").alias("centre"))
        pieces = lambda c: F.ceil(F.col(c) / largest).cast("int")
        spread = chosen.select("home", "pivot", "centre", F.explode(F.sequence(F.lit(0), pieces("of") - 1)).alias("part")).groupBy("home", "part")
        rows = inside.select("shard", F.pmod(F.xxhash64("node"), pieces("size")).cast("int").alias("piece"), "node", "vec").groupBy("shard", "piece")
        cells = cut(rows.cogroup(spread).applyInArrow(_cut_again(overlap), CELLS))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _cut_again(overlap: int):
    def run(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        """A piece of a large shard, divided among the shard's own pivots."""
        if not rows.num_rows or not chosen.num_rows:
            return rows.select(["shard", "node"])
        old = np.uint64(rows["shard"][0].as_py() & ((1 << 64) - 1))
        names = tk.signed(tk.mix(chosen["pivot"].to_numpy().view(np.uint64) + tk.mix(np.array([old]))))
        order = np.argsort(names)
        return _cells(rows["node"].to_numpy(), _unit(rows["vec"]), names[order], _unit(chosen["centre"])[order], max(1, min(overlap, len(order) // 8)))

    return run


def robust_prune(v: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(len(at) x degree) neighbours of vectors ``at`` out of ``cand``, -1 where there are fewer."""
    out = np.full((len(at), degree), -1, np.int64)
    for lo in range(0, len(at), _CHUNK):
        a, c = at[lo : lo + _CHUNK], cand[lo : lo + _CHUNK]
        cv = v[c]
        to = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", v[a], cv)))
        between = np.sqrt(np.maximum(0, 2 - 2 * (cv @ cv.transpose(0, 2, 1))))
        alive = (c >= 0) & (c != a[:, None])
        rows = np.arange(len(a))
        for j in range(degree):
            best = np.where(alive, to, np.inf).argmin(axis=1)
            ok = alive[rows, best]
            if not ok.any():
                break
            out[lo + rows[ok], j] = c[rows[ok], best[ok]]
            alive &= alpha * between[rows, best] > to
            alive[rows, best] = False
    return out


def medoid(v: np.ndarray) -> int:
    return int((v @ v.mean(axis=0)).argmax())


def build(v: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The pruned graph of one shard, padded with -1; the last column is a random ring, so that nothing is out of reach."""
    n = len(v)
    everyone = np.arange(n)
    if n <= degree + 1:
        full = np.tile(everyone, (n, 1))
        return np.where(full == everyone[:, None], -1, full)
    k = min(CANDIDATES, n - 1)
    cand = np.empty((n, k), np.int64)
    for lo in range(0, n, _CHUNK):
        cand[lo : lo + _CHUNK] = np.argpartition(-(v[lo : lo + _CHUNK] @ v.T), k, axis=1)[:, :k] if k < n - 1 else np.tile(everyone[:k], (len(v[lo : lo + _CHUNK]), 1))
    rnd = (tk.mix(np.arange(n * RANDOM, dtype=np.uint64)) % np.uint64(n)).astype(np.int64).reshape(n, RANDOM)
    cand = np.concatenate([cand, rnd, np.full((n, 1), medoid(v))], axis=1)
    out = robust_prune(v, everyone, cand, degree, alpha)
    src, col = np.nonzero(out >= 0)
    dst = out[src, col]
    order = np.lexsort((tk.mix(src.astype(np.uint64)), dst))  # some reverse edges of each, in random order
    src, dst = src[order], dst[order]
    nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.full((n, degree), -1, np.int64)
    few = nth < degree
    back[dst[few], nth[few]] = src[few]
    out = robust_prune(v, everyone, np.concatenate([out, back], axis=1), degree, alpha)
    order = np.argsort(tk.mix(everyone.astype(np.uint64)))
    ring = np.empty(n, np.int64)
    ring[order] = np.roll(order, -1)
    return np.concatenate([out, ring[:, None]], axis=1)


def search(v: np.ndarray, graph: np.ndarray, queries: np.ndarray, min_cosine: float, breadth: int, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``queries``, found) in range: greedy search from the medoid, or from ``seeds`` (row, place), expanded over the range."""
    start = medoid(v)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(v)
    least = min_cosine - 1e-5
    for lo in range(0, len(queries), _CHUNK):
        q = queries[lo : lo + _CHUNK]
        rows = np.arange(len(q))
        seen = np.full((len(q), n), -np.inf, np.float32)  # cosines of what was visited
        todo = np.full((len(q), n), -np.inf, np.float32)  # of what isn't expanded yet
        if seeds is None:
            seen[:, start] = todo[:, start] = q @ v[start]
        else:
            mine = np.flatnonzero((seeds[0] >= lo) & (seeds[0] < lo + len(q)))
            r, at = seeds[0][mine] - lo, seeds[1][mine]
            seen[r, at] = todo[r, at] = np.einsum("nd,nd->n", q[r], v[at])
        while len(rows):
            k = min(_FANOUT, n)
            part = np.argpartition(-todo[rows], k - 1, axis=1)[:, :k]
            value = np.take_along_axis(todo[rows], part, 1)
            b = min(breadth, n)
            bound = np.minimum(-np.partition(-seen[rows], b - 1, axis=1)[:, b - 1], least)  # the list's last, or the range
            go = (value > -np.inf) & (value >= bound[:, None])
            live = go.any(axis=1)
            rows, part, go = rows[live], part[live], go[live]
            i, j = np.nonzero(go)
            r, at = rows[i], part[i, j]
            todo[r, at] = -np.inf
            nb = graph[at]
            r2, nb = np.repeat(r, nb.shape[1]), nb.ravel()
            new = nb >= 0
            new[new] = seen[r2[new], nb[new]] == -np.inf
            key = np.unique(r2[new] * n + nb[new])
            r2, nb = key // n, key % n
            cosine = np.einsum("nd,nd->n", q[r2], v[nb])
            seen[r2, nb] = todo[r2, nb] = cosine
        a, b = np.nonzero(seen >= least)
        out.append((a + lo, b))
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Forest:
    """Which of the links that come in chunks make a spanning forest of ``n`` places."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        root, out = self.root, np.zeros(len(a), bool)
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return out
        _, first = np.unique(np.minimum(x, y)[apart] * len(root) + np.maximum(x, y)[apart], return_index=True)
        up: dict[int, int] = {}  # of roots only

        def top(z: int) -> int:
            while (w := up.get(z, z)) != z:
                up[z] = up.get(w, w)
                z = w
            return z

        for i in apart[first].tolist():
            p, q = top(int(x[i])), top(int(y[i]))
            if p != q:
                up[max(p, q)], out[i] = min(p, q), True
        new = np.arange(len(root))
        for z in list(up):
            new[z] = top(z)
        self.root = new[root]
        return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _homes(column: pa.ChunkedArray, ids: np.ndarray) -> np.ndarray:
    """(rows x most) places of a list column's values in ``ids``, in order; -1 where there are fewer."""
    column = _one(column)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), len(ids), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.searchsorted(ids, column.flatten().to_numpy(zero_copy_only=False))
    out.sort(axis=1)
    return np.where(out == len(ids), -1, out)


def _in_range(q: np.ndarray, v: np.ndarray, least: float, own: bool):
    """(query, found) in chunks; of a shard's own vectors each pair once."""
    step = max(1, min(512, (1 << 22) // max(1, len(v))))
    for lo in range(0, len(q), step):
        begin = lo if own else 0
        block = q[lo : lo + step] @ v[begin:].T
        hits = np.flatnonzero(block.ravel() >= least)
        a, b = hits // block.shape[1], hits % block.shape[1]
        if own:
            a, b, hits = a[b > a], b[b > a], hits[b > a]
        value = block.ravel()[hits]
        for at in range(0, len(a), _PAIRS):
            yield a[at : at + _PAIRS] + lo, b[at : at + _PAIRS] + begin, value[at : at + _PAIRS]


def _walked(v: np.ndarray, least: float, breadth: int):
    """As _in_range() of a shard's own vectors, by its graph."""
    a, b = search(v, build(v), v, least, breadth)
    key = np.unique(np.minimum(a, b) * len(v) + np.maximum(a, b))
    a, b = key // len(v), key % len(v)
    a, b = a[a != b], b[a != b]
    for at in range(0, len(a), _PAIRS):
        x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
        yield x, y, np.einsum("nd,nd->n", v[x], v[y])


def _shard_links(min_cosine: float, breadth: int, whole: int):
    """LINKS of a shard, and where to go on: rows with ``to``, a further shard, for query a."""
    names_out = [x.split()[0] for x in LINKS.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        t = t.sort_by("node")
        guest = t["guest"].to_numpy()
        node, weight = t["node"].to_numpy(), t["n"].to_numpy()
        exact = _unit(t["vec"])
        ids = np.unique(np.append(_one(t["homes"]).flatten().to_numpy(zero_copy_only=False), shard))
        homes, here = _homes(t["homes"], ids), int(np.searchsorted(ids, shard))
        own, asks = np.flatnonzero(~guest), np.flatnonzero(guest)
        v = exact.astype(np.float32)
        least = min_cosine - _DOUBT
        forest = _Forest(len(node))
        parts: list[pa.Table] = []
        further = [np.zeros(0, np.int64)]

        def take(a: np.ndarray, b: np.ndarray, value: np.ndarray, ours: bool) -> None:
            doubt = np.flatnonzero(value < min_cosine + _DOUBT)
            if len(doubt):
                ok = np.ones(len(a), bool)
                for lo in range(0, len(doubt), 1 << 14):
                    d = doubt[lo : lo + (1 << 14)]
                    ok[d] = np.einsum("nd,nd->n", exact[a[d]], exact[b[d]]) >= min_cosine
                a, b = a[ok], b[ok]
            if not len(a):
                return
            ha, hb = homes[a], homes[b]
            shared = ((ha[:, :, None] == hb[:, None, :]) & (ha[:, :, None] >= 0)).any(axis=2)
            some = shared.any(axis=1)
            if ours:
                keep = ha[np.arange(len(a)), shared.argmax(axis=1)] == here
            else:
                keep = ~some  # else a common shard has it
            a, b, ha, hb = a[keep], b[keep], ha[keep], hb[keep]
            for x, hx, hy in [(a, ha, hb), (b, hb, ha)][: 1 + ours]:
                new = (hy >= 0) & (hy != here) & ~(hy[:, :, None] == hx[:, None, :]).any(axis=2)
                r, c = np.nonzero(new)
                further.append(np.unique(x[r] * len(ids) + hy[r, c]))
            if len(further) > 64:
                further[:] = [np.unique(np.concatenate(further))]
            lo, hi = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
            tree = np.zeros(len(a), bool)
            real = np.flatnonzero((weight[lo] > 0) & (weight[hi] > 0))
            tree[real] = forest.add(lo[real], hi[real])
            parts.append(pa.table([pa.array(node[lo]), pa.array(node[hi]), pa.array(weight[lo]), pa.array(weight[hi]), pa.array(tree), pa.nulls(len(a), pa.int64())], names=names_out))

        if len(asks):
            mine = v[own]
            for a, b, value in _in_range(v[asks], mine, least, False):
                take(asks[a], own[b], value, False)
        else:
            for a, b, value in _in_range(v, v, least, True) if len(v) <= whole else _walked(v, min_cosine, breadth):
                take(a, b, value, True)
        on = np.unique(np.concatenate(further))
        zero = pa.array(np.zeros(len(on), np.int64))
        parts.append(pa.table([pa.array(node[on // len(ids)]), zero, zero, zero, pa.array(np.zeros(len(on), bool)), pa.array(ids[on % len(ids)])], names=names_out))
        return pa.concat_tables(parts)

    return run


def linked(points: DataFrame, shard: int, overlap: int, breadth: int, min_cosine: float, pivots: int = PIVOTS, largest: int = LARGEST, whole: int = COMPARED) -> DataFrame:
    """(a, b, na, nb, tree): the links a < b found among ``points(node, n, vec)``, once each; those with tree connect all."""
    homes = assign(points, shard, overlap, pivots, largest).groupBy("node").agg(F.collect_set("shard").alias("homes"))
    placed = cut(points.select("node", "n", "vec").join(homes, "node"))
    cells = placed.select(F.explode("homes").alias("shard"), "*", F.lit(False).alias("guest"))
    compare = lambda rows: cut(rows.groupBy("shard").applyInArrow(_shard_links(min_cosine, breadth, whole), LINKS))
    got = compare(cells)
    out = got.filter("to IS NULL").drop("to")
    extra, asked = [], None
    while True:
        on = got.filter("to IS NOT NULL").select(F.col("to").alias("shard"), F.col("a").alias("node")).distinct()
        on = cut(on if asked is None else on.join(asked, ["shard", "node"], "left_anti"))
        if on.isEmpty():
            break
        asked = on if asked is None else asked.unionByName(on)
        guests = on.join(placed, "node").select("shard", "node", "n", "vec", "homes", F.lit(True).alias("guest"))
        got = compare(cells.join(on.select("shard").distinct(), "shard", "left_semi").unionByName(guests))
        extra.append(got.filter("to IS NULL").drop("to"))
    if extra:  # links without a common shard, which either end may have found
        more = extra[0]
        for x in extra[1:]:
            more = more.unionByName(x)
        out = out.unionByName(more.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("tree").alias("tree")))
    return out


def compared(points: DataFrame, sample: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(x, y): all near vectors y among ``points`` of the few vectors x of ``sample(node, vec)``, by brute force."""
    rows = sample.select("node", "vec").toArrow()
    dims = np.array([len(x) for x in rows["vec"]], np.int64)
    by = {int(d): rows.take(pa.array(np.flatnonzero(dims == d))) for d in np.unique(dims)}
    shared = points.sparkSession.sparkContext.broadcast({d: (g["node"].to_numpy(), _unit(g["vec"])) for d, g in by.items()})

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                dims = np.diff(batch.column("vec").offsets.to_numpy())
                for dim in np.unique(dims):
                    if int(dim) not in shared.value:
                        continue
                    names, v = shared.value[int(dim)]
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    own = part.column("node").to_numpy()
                    i, j = np.nonzero(_unit(part.column("vec")) @ v.T >= min_cosine)
                    ok = own[i] != names[j]
                    yield pa.RecordBatch.from_arrays([pa.array(names[j[ok]]), pa.array(own[i[ok]])], ["x", "y"])

    return points.select("node", "vec").mapInArrow(run, "x long, y long")


def lower_bound(share: float, worth: float, z: float = Z) -> float:
    """Wilson's lower confidence bound (95 %, one-sided) of a share of ``worth`` independent draws."""
    if not worth:
        return 0.0
    return (share + z * z / (2 * worth) - z * math.sqrt(share * (1 - share) / worth + z * z / (4 * worth * worth))) / (1 + z * z / worth)


def audit(true: DataFrame, found: DataFrame) -> tuple[float, int]:
    """(recall, number of vectors that have links in compared()).

    Recall is the share of the links that is in ``found``, of all together or
    as the mean over the vectors, whichever is less.  Links of one vector are
    found or missed together, so it is the vectors that count as draws.
    """
    pairs = true.select("x", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    per = pairs.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("x").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    r = per.agg(F.count("*").alias("draws"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.avg(F.col("hits") / F.col("n")).alias("mean")).first()
    return (min(r["hits"] / r["n"], r["mean"]), r["draws"]) if r["n"] else (1.0, 0)


def starting_overlap(n: int, shard: int = SHARD, overlap: int = OVERLAP) -> int:
    """Nearest pivots whose shards a vector joins at first."""
    return max(overlap, math.ceil(math.log2(max(1, -(-n // shard))) / 2))


def links(points: DataFrame, min_cosine: float = MIN_COSINE, shard: int = SHARD, overlap: int = OVERLAP, breadth: int = BREADTH, recall: float = RECALL, n_probes: int = PROBES, pivots: int = PIVOTS, largest: int = LARGEST) -> tuple[DataFrame, float, float]:
    """(links a < b of ``points(node, n, vec)``, audited recall, its lower confidence bound)."""
    planted = cut(probes(points, n_probes, min_cosine)).join(points.select("node"), "node", "left_anti")
    every = cut(points.select("node", "n", "vec").unionByName(planted.select("node", F.lit(0).cast("long").alias("n"), "vec")))
    sample = planted.select("node", "vec").unionByName(points.join(planted.select(F.col("of").alias("node")), "node", "left_semi").select("node", "vec"))
    true = cut(compared(every, sample, min_cosine).distinct())
    n = every.count()
    overlap = starting_overlap(n, shard, overlap)
    while True:
        found = cut(linked(every, shard, overlap, breadth, min_cosine, pivots, largest))
        share, worth = audit(true, found)
        bound = lower_bound(share, worth)
        if bound >= recall or not worth or (share == 1.0 and breadth >= n):  # a few vectors give no high bound, but all of them were met
            return found.filter("na > 0 AND nb > 0"), share, bound
        breadth, overlap = breadth * 2, overlap + 1


def _block_links(min_cosine: float):
    """The links of two blocks, or of one within itself, once each."""

    def run(t: pa.Table) -> pa.Table:
        first = t["block"].to_numpy() == t["i"].to_numpy()
        own = t["i"][0].as_py() == t["j"][0].as_py()
        node, weight, exact = t["node"].to_numpy(), t["n"].to_numpy(), _unit(t["vec"])
        left = np.flatnonzero(first)
        right = left if own else np.flatnonzero(~first)
        v = exact.astype(np.float32)
        forest, parts = _Forest(len(node)), []
        for a, b, value in _in_range(v[left], v[right], min_cosine - _DOUBT, own):
            a, b = left[a], right[b]
            ok = value >= min_cosine + _DOUBT
            doubt = np.flatnonzero(~ok)
            for lo in range(0, len(doubt), 1 << 14):
                d = doubt[lo : lo + (1 << 14)]
                ok[d] = np.einsum("nd,nd->n", exact[a[d]], exact[b[d]]) >= min_cosine
            a, b = a[ok], b[ok]
            lo, hi = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
            parts.append(pa.table([pa.array(node[lo]), pa.array(node[hi]), pa.array(weight[lo]), pa.array(weight[hi]), pa.array(forest.add(lo, hi))], names=["a", "b", "na", "nb", "tree"]))
        return pa.concat_tables(parts) if parts else pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("tree", pa.bool_())]).empty_table()

    return run


def all_links(points: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """(a, b, na, nb, tree): every link a < b of ``points(node, n, vec)``, none left out; those with tree connect all.

    All pairs are compared, block by block.  The comparisons are quadratic in
    the vectors and what is shuffled is their number times that of the blocks,
    but a task holds two blocks however many there are.
    """
    n = points.count()
    busy = math.ceil(math.sqrt(2 * points.sparkSession.sparkContext.defaultParallelism))
    blocks = max(-(-n // block), min(busy, -(-n // 1024)), 1)
    own = points.select("node", "n", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    sent = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select("node", "n", "vec", "dim", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = blocks * (blocks + 1) // 2
    return sent.repartition(2 * pairs, "dim", "i", "j").groupBy("dim", "i", "j").applyInArrow(_block_links(min_cosine), "a long, b long, na long, nb long, tree boolean")


def near_duplicates(embeddings: DataFrame, min_cosine: float = MIN_COSINE, exact: bool = False, **kw) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector; with ``exact`` all pairs are compared, in place of the shards'."""
    rows = cut(members(embeddings))
    points = cut(nodes(rows))
    found = cut(all_links(points, min_cosine)) if exact else links(points, min_cosine, **kw)[0]
    group = components(found.filter("tree").select("a", "b"))
    named = points.join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("nb").alias("w")), F.struct(F.col("b").alias("node"), F.col("na").alias("w")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.w").alias("w"))
    per = named.join(classes, "root").join(counts, "node", "left").select("node", "class_id", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return rows.select("vec_id", F.xxhash64("vec").alias("node")).join(per, "node").select("vec_id", "class_id", "n_links")


#: Two perturbed copies of each vector, the nearer to it the less the id leaves over; one in ten is an exact copy.
PERTURBED = {
    "spark": "SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding FROM {embeddings} UNION ALL SELECT -1 - 2 * vec_id - k, transform(embedding, (x, i) -> CAST(x AS DOUBLE) + (vec_id % 10) / 20.0D * CAST(embedding[(i + 1 + k) % size(embedding)] AS DOUBLE)) FROM {embeddings} CROSS JOIN (SELECT explode(array(0, 1)) AS k) c",
    "duckdb": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL SELECT -1 - 2 * vec_id - k, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + (vec_id % 10) / 20.0::DOUBLE * CAST(embedding[(i + k) % len(embedding) + 1] AS DOUBLE)) FROM embeddings CROSS JOIN (SELECT unnest([0, 1]) AS k) c",
}


def oracle(min_cosine: float = MIN_COSINE, table: str = "embeddings") -> str:
    """DuckDB SQL for near_duplicates(embeddings): all pairs compared, classes by transitive closure."""
    ok = "vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)"
    return f"""
    WITH RECURSIVE e AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS r FROM (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM ({table}) WHERE {ok})),
    p AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {min_cosine}),
    c AS (SELECT r, r AS other FROM e UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.other)
    SELECT e.vec_id, k.class_id, coalesce(l.n, 0) AS n_links FROM e
      JOIN (SELECT c.r, min(o.vec_id) AS class_id FROM c JOIN e o ON o.r = c.other GROUP BY c.r) k ON k.r = e.r
      LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.r"""
