"""Op 2: vectors within a cosine threshold by cover trees and dual traversal.

Vectors are scaled to unit length; cosine >= t is distance <= sqrt(2 - 2t).
Equal vectors are one point with a weight, first inside each batch that a task
reads and then in their block, so a vector that fills a third of the table
crosses the exchange once a batch.

Blocks.  Pivots from a bounded sample are the top cover.  A point goes to the cell
of its nearest pivot, cells are cut into blocks by a hash, and each block becomes
a cover tree, built once and written to the shared folder as one row.

Trees.  Levels have radii 2, 1, 1/2, ...  A node's children are chosen among its
own points, its centre first (so centres nest), greedily until every point of the
node lies within the next level's radius of one of them; children are farther
apart than that radius, and there is no limit on the number of children.  Levels
are left out at which a node would not split, or at which two children as far
apart as its points are on the whole could not be told to be out of reach.  Every node knows the true covering
radius of its points.

Traversal.  Two trees are traversed together, all children of one node against
all children of the other at once: a pair of nodes is dropped when even their
nearest points are too far, accepted whole when even their farthest points are
near enough, and else split further.  Bounds are computed in single precision
with room for its error, which grows with the dimension, so no pair is lost; a
pair is a link iff its double-precision cosine is >= the threshold.  Only counts
and a spanning set of links leave a task, never all pairs of a dense group.

Work.  Every block meets half of the others (those whose roots the bounds cannot
exclude), so a vector crosses the exchange 1 + blocks / 2 times.  The number of
blocks is at most 32 until blocks reach 16 MB, which keeps the exchange in
proportion to the input up to some millions of vectors; beyond, where vectors have
no structure that a bound can use, the work of an exact join is quadratic, in
blocks as large as memory allows.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite
component link with nothing and are their own component; vectors of different
lengths never link; rows that repeat an identifier are vectors of their own, each
with its links; rows without identifier are vectors that count as links and have
a null component; of equal smallest identifiers in a component all rows are kept;
extra columns are not used; an empty table gives no rows; vectors may be long, a
block holding at least one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import components, n_parts, stash

_FIELDS = ("order", "centre", "radius", "lo", "hi", "kid_lo", "kid_hi")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def room(dim: int) -> float:
    """Bound on the error of a single-precision product of two unit vectors."""
    return (dim + 8) * 2.0**-23


def far(cos: np.ndarray, err: float) -> np.ndarray:
    """Upper bound of the distance."""
    return np.sqrt(np.maximum(2 - 2 * (cos - err), 0))


def close(cos: np.ndarray, err: float) -> np.ndarray:
    """Lower bound of the distance."""
    return np.sqrt(np.maximum(2 - 2 * (cos + err), 0))


class CoverTree:
    """Nodes as arrays: centre (a row), covering radius, range [lo, hi) of
    ``order``, and range of children; children lie together, by radius."""

    def __init__(self, points: np.ndarray, leaf: int = 16, reach: float = 0.0, state: dict[str, np.ndarray] | None = None) -> None:
        self.x, self.err = np.ascontiguousarray(points, np.float32), room(points.shape[1])
        if state is not None:
            self.__dict__.update(state)
            return
        n, self.reach = len(points), reach
        self.order = np.arange(n, dtype=np.int32)
        kinds = {"centre": np.int32, "radius": np.float32, "lo": np.int32, "hi": np.int32, "kid_lo": np.int32, "kid_hi": np.int32}
        parts: dict[str, list[np.ndarray]] = {f: [np.zeros(1, k)] for f, k in kinds.items()}
        parts["hi"][0][0] = n
        if n:
            parts["radius"][0][0] = far((self.x @ self.x[0]).min(), self.err)
        todo, made = [(0, 0, n, 0, float(parts["radius"][0][0]))], 1
        links: dict[int, tuple[int, int]] = {}
        while todo:
            node, a, b, centre, radius = todo.pop()
            if b - a <= leaf:
                continue
            rows = self.order[a:b].copy()
            owner, centres, cos = self._net(rows, centre, radius)
            if len(centres) == 1:
                continue  # points that single precision cannot tell apart
            size = np.bincount(owner, minlength=len(centres))
            low = np.full(len(centres), np.inf, np.float32)
            np.minimum.at(low, owner, cos)
            reach = np.where(size > 1, far(low, self.err), 0).astype(np.float32)
            rank = np.argsort(reach, kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            self.order[a:b] = rows[np.argsort(place[owner], kind="stable")]
            hi = a + np.cumsum(size[rank])
            lo = hi - size[rank]
            zero = np.zeros(len(rank), np.int32)
            for f, v in zip(kinds, (centres[rank], reach[rank], lo, hi, zero, zero)):
                parts[f].append(v.astype(kinds[f]))
            links[node] = (made, made + len(rank))
            todo += [(made + i, int(lo[i]), int(hi[i]), int(centres[rank[i]]), float(reach[rank[i]])) for i in np.flatnonzero(size[rank] > leaf).tolist()]
            made += len(rank)
        self.__dict__.update({f: np.concatenate(p) for f, p in parts.items()})
        for node, (a, b) in links.items():
            self.kid_lo[node], self.kid_hi[node] = a, b

    def _net(self, rows: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of a node: for each row its child and the cosine to that
        child's centre, and the centres.  The radius is the largest 2 / 2**k below
        the node's own that leaves more than one child."""
        x = self.x[rows]
        first = x @ self.x[centre]
        bound = 2.0
        while bound >= radius:
            bound /= 2
        some = x[:: max(1, len(x) // 256)][:256]
        apart = np.median(close(some @ some[:64].T, 0.0))
        while bound > self.reach / 4 and apart <= self.reach + 2 * bound:
            bound /= 2
        while (first >= 1 - bound * bound / 2).all():
            bound /= 2
            if bound * bound / 2 < self.err:
                return np.zeros(len(rows), np.int64), np.array([centre]), first
        need = np.float32(1 - bound * bound / 2)
        owner, cos = np.where(first >= need, 0, -1), first.copy()
        centres = [np.array([centre])]
        made, left = 1, np.flatnonzero(owner < 0)
        while len(left):
            some = left[:512]
            near = x[some] @ x[some].T >= need
            covered, taken = np.zeros(len(some), bool), []
            for i in range(len(some)):
                if not covered[i]:
                    taken.append(i)
                    covered |= near[i]
            new = some[taken]
            found = x[left] @ x[new].T
            best = found.argmax(axis=1)
            value = found[np.arange(len(left)), best]
            hit = value >= need
            owner[left[hit]], cos[left[hit]] = made + best[hit], value[hit]
            owner[new], cos[new] = made + np.arange(len(new)), 1.0
            centres.append(rows[new])
            made += len(new)
            left = left[owner[left] < 0]
        return owner, np.concatenate(centres), cos

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in _FIELDS})
        return out.getvalue()

    @staticmethod
    def unpack(points: np.ndarray, raw: bytes) -> CoverTree:
        found = np.load(io.BytesIO(raw), allow_pickle=False)
        return CoverTree(points, state={f: found[f] for f in _FIELDS})


def dual(one: CoverTree, two: CoverTree, cosine: float, near, inside, within=None, tile: int = 2048) -> None:
    """Traverse two trees together.  near(rows_a, rows_b) gets pairs to decide,
    inside(rows_a, rows_b) whole nodes all of whose pairs are links.  With
    ``within`` the trees are one, each unordered pair is visited once, and
    within(rows) gets whole nodes all of whose own pairs are links."""
    same = within is not None
    if not len(one.x) or not len(two.x):
        return
    reach, err = float(np.sqrt(max(0.0, 2 - 2 * cosine))), one.err
    need = np.float32(cosine - err)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        itself = same and x == y
        if itself and 2 * float(one.radius[x]) < reach - 1e-6:
            within(one.order[one.lo[x] : one.hi[x]])
            continue
        leaf_x, leaf_y = one.kid_lo[x] == one.kid_hi[x], two.kid_lo[y] == two.kid_hi[y]
        if leaf_x and leaf_y:
            p, q = one.order[one.lo[x] : one.hi[x]], two.order[two.lo[y] : two.hi[y]]
            mask = one.x[p] @ two.x[q].T >= need
            if itself:
                mask = np.triu(mask, 1)
            i, j = np.nonzero(mask)
            if len(i):
                near(p[i], q[j])
            continue
        a = np.array([x]) if leaf_x else np.arange(one.kid_lo[x], one.kid_hi[x])
        b = np.array([y]) if leaf_y else np.arange(two.kid_lo[y], two.kid_hi[y])
        for s in range(0, len(a), tile):
            rows_a = a[s : s + tile]
            xa, ra = one.x[one.centre[rows_a]], one.radius[rows_a]
            for t in range(s if itself else 0, len(b), tile):
                rows_b = b[t : t + tile]
                rb = two.radius[rows_b]
                cos = xa @ two.x[two.centre[rows_b]].T
                most = reach + float(ra[-1] if len(ra) else 0) + float(rb[-1] if len(rb) else 0)  # children lie by radius
                i, j = np.nonzero(cos >= (1 - most * most / 2 - 2 * err if most < 2 else -2))
                if itself and s == t:
                    upper = i <= j
                    i, j = i[upper], j[upper]
                c, r = cos[i, j], ra[i] + rb[j]
                keep = close(c, err) <= reach + r + 1e-6
                i, j, c, r = i[keep], j[keep], c[keep], r[keep]
                u, v = rows_a[i], rows_b[j]
                own = u == v if itself else np.zeros(len(u), bool)
                single = (one.hi[u] - one.lo[u] == 1) & (two.hi[v] - two.lo[v] == 1) & ~own
                if single.any():
                    ok = single & (c >= need)
                    near(one.order[one.lo[u[ok]]], two.order[two.lo[v[ok]]])
                whole = ~single & ~own & (far(c, err) + r < reach - 1e-6)
                for k in np.flatnonzero(whole).tolist():
                    inside(one.order[one.lo[u[k]] : one.hi[u[k]]], two.order[two.lo[v[k]] : two.hi[v[k]]])
                more = ~single & ~whole & ~(own & (one.hi[u] - one.lo[u] == 1))
                todo += zip(u[more].tolist(), v[more].tolist())


class _Links:
    """Counts and a spanning set of links among n points."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.count, p, self.weight[q])
        np.add.at(self.count, q, self.weight[p])
        self.join(p, q)

    def decide(self, p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float, shift: int = 0) -> None:
        """Take the pairs whose double-precision cosine reaches the threshold."""
        for a in range(0, len(p), 1 << 16):
            i, j = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            self.pairs(i[sure], j[sure] + shift)

    def within(self, p: np.ndarray) -> None:
        self.count[p] += self.weight[p].sum() - self.weight[p]
        self.join(p[1:], np.full(len(p) - 1, p[0]))

    def whole(self, p: np.ndarray, q: np.ndarray) -> None:
        self.count[p] += self.weight[q].sum()
        self.count[q] += self.weight[p].sum()
        self.join(np.append(p, np.full(len(q), p[0])), np.append(np.full(len(p), q[0]), q))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, dim, vec): the components as bytes of their own type (null where
    the vector is not usable) and a 128-bit key of the unit vector."""
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    dtype = np.float32 if kind == "float" else np.float64
    data = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = column.flatten()
            missing = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
            stop = np.cumsum(size)
            start = stop - size
            ok = (size > 0) & (missing[stop] == missing[start])
            keys, raws = [None] * len(size), [None] * len(size)
            for dim in np.unique(size[ok]).tolist():
                rows = np.flatnonzero(ok & (size == dim))
                x = flat[start[rows][:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[fine], x[fine]
                if len(rows):
                    for r, u, v in zip(rows.tolist(), unit(x), x):
                        keys[r], raws[r] = xxhash.xxh128_digest(u.tobytes()), v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(size.astype(np.int32)), pa.array(raws, pa.binary())], ["id", "key", "dim", "vec"])

    return data.mapInArrow(run, "id long, key binary, dim int, vec binary")


_BLOCK = "block long, n int, dim int, vecs binary, keys binary, ids binary, named binary, weights binary, tree binary"


def block_trees(rows: DataFrame, dim: int, dtype, total: int, block: int | None, reach: float) -> DataFrame:
    """One row per block (_BLOCK): its distinct points and their cover tree."""
    spark = rows.sparkSession
    if block is None:
        block = max(1, min(max(16_384, -(-total // 32)), (16 << 20) // (dim * np.dtype(dtype).itemsize)))
    wanted = int(min(1024, max(1, -(-total // block))))
    rate = max(1, total // max(4 * wanted, 4000))
    mark = F.xxhash64("vec")
    sample = rows.where(F.pmod(mark, F.lit(rate)) == 0).select("vec", mark.alias("h")).dropDuplicates(["vec"]).orderBy("h", "vec").limit(wanted).select("vec").collect()
    sample = sample or rows.select("vec").limit(1).collect()
    pivots = unit(np.stack([np.frombuffer(bytes(r[0]), dtype) for r in sample])).astype(np.float32)

    def stack(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct points of a batch: (cell, key, vec, id, named, weight)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([int.from_bytes(k[:8], "little") for k in batch.column(1).to_pylist()], np.uint64)
            _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            ids = batch.column(0)
            given = ids.is_valid().to_numpy(zero_copy_only=False)
            low = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(low, back[given], ids.fill_null(0).to_numpy(zero_copy_only=False)[given])
            named = np.bincount(back, weights=given, minlength=len(first)).astype(np.int64)
            one = batch.take(pa.array(first))
            cell = (unit(stack(one.column(3))).astype(np.float32) @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), one.column(1), one.column(3), pa.array(low), pa.array(named), pa.array(count.astype(np.int64))], ["cell", "key", "vec", "id", "named", "weight"])

    points = rows.select("id", "key", "dim", "vec").mapInArrow(place, "cell long, key binary, vec binary, id long, named long, weight long")
    sizes = {r[0]: r[1] for r in points.groupBy("cell").agg(F.approx_count_distinct("key").alias("n")).collect()}  # one row per pivot
    parts = np.array([max(1, -(-sizes.get(i, 0) // block)) for i in range(len(pivots))], np.int64)
    base = F.array(*[F.lit(int(b)) for b in np.cumsum(parts) - parts])
    cut = F.array(*[F.lit(int(b)) for b in parts])
    cell = F.col("cell").cast("int")
    dealt = points.withColumn("block", (F.get(base, cell) + F.pmod(F.xxhash64("key"), F.get(cut, cell))).cast("long"))
    n = max(n_parts(spark), min(int(parts.sum()), 20_000))
    sorted_ = dealt.select("block", "key", "vec", "id", "named", "weight").repartition(n, "block").sortWithinPartitions("block", "key")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def give() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_pylist()
            new = np.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
            at = np.flatnonzero(new)
            ids, named, weight = (t.column(c).to_numpy() for c in ("id", "named", "weight"))
            x = stack(t.column("vec").take(pa.array(at)))
            tree = CoverTree(unit(x).astype(np.float32), reach=reach)
            sums = [np.minimum.reduceat(ids, at), np.add.reduceat(named, at), np.add.reduceat(weight, at)]
            cols = [now, len(at), dim, x.tobytes(), b"".join(key[i] for i in at.tolist()), *[v.astype(np.int64).tobytes() for v in sums], tree.pack()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            block_ = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(block_)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if block_[a] != now and held:
                    yield give()
                    held = []
                now = int(block_[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield give()

    return sorted_.mapInArrow(build, _BLOCK)


def _numbers(block: int, n: int) -> np.ndarray:
    """Numbers of a block's points in the whole table."""
    return (np.int64(block) << np.int64(24)) + np.arange(n, dtype=np.int64)


def block_links(blocks: DataFrame, dim: int, dtype, cosine: float) -> DataFrame:
    """(point, n, other): link counts of points, and links that span what is linked."""
    spark = blocks.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def tree_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
        row = {c: batch.column(c)[i].as_py() for c in ("vecs", "weights", "tree")}
        x = unit(np.frombuffer(row["vecs"], dtype).reshape(-1, dim))
        return x, np.frombuffer(row["weights"], np.int64), CoverTree.unpack(x.astype(np.float32), row["tree"])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, _, tree = tree_of(batch, i)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([tree.x[tree.centre[0]].tobytes()], pa.binary()), pa.array([float(tree.radius[0])])], ["block", "centre", "radius"])

    tops = blocks.mapInArrow(roots, "block long, centre binary, radius double").orderBy("block").collect()  # one row per block
    names = np.array([r["block"] for r in tops], np.int64)
    centres = np.stack([np.frombuffer(bytes(r["centre"]), np.float32) for r in tops])
    radii = np.array([r["radius"] for r in tops])
    count = len(names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block is at home once, and a guest at those up to halfway round the
        circle before it, unless their roots are too far apart."""
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                me = int(np.searchsorted(names, row.column("block")[0].as_py()))
                gap = close(centres @ centres[me], room(dim))
                may = gap <= reach + radii + radii[me] + 1e-6
                steps = [k for k in range(1, count // 2 + 1) if may[(me - k) % count] and not (2 * k == count and me < k)]
                for k in [0, *steps]:
                    yield pa.RecordBatch.from_arrays([pa.array([int(names[(me - k) % count])]), pa.array([k > 0]), *[row.column(c) for c in ("block", "vecs", "weights", "tree")]], ["home", "guest", "block", "vecs", "weights", "tree"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, at, x, weight, tree = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column("block")[r].as_py()
                y, w, other = tree_of(batch, r)
                if not batch.column("guest")[r].as_py():
                    home, x, weight, tree = name, y, w, other
                    links = _Links(weight)
                    dual(tree, tree, cosine, lambda p, q: links.decide(p, q, x, x, cosine), links.whole, links.within)  # noqa: B023
                    at = _numbers(home, len(x))
                else:
                    if batch.column("home")[r].as_py() != home:
                        raise RuntimeError("a guest came before its home")
                    n = len(x)
                    links = _Links(np.append(weight, w))
                    dual(tree, other, cosine, lambda p, q: links.decide(p, q, x, y, cosine, n), lambda p, q: links.whole(p, q + n))  # noqa: B023
                    at = np.append(_numbers(home, n), _numbers(name, len(y)))
                hit = np.flatnonzero(links.count)
                tied = np.flatnonzero(links.root != np.arange(len(at)))
                none = np.append(np.ones(len(hit), bool), np.zeros(len(tied), bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(at[hit], at[tied])), pa.array(np.append(links.count[hit], np.zeros(len(tied), np.int64))), pa.array(np.append(np.zeros(len(hit), np.int64), at[links.root[tied]]), mask=none)],
                    ["point", "n", "other"],
                )

    dealt = blocks.mapInArrow(deal, "home long, guest boolean, block long, vecs binary, weights binary, tree binary")
    n = max(n_parts(spark), min(count, 20_000))
    return dealt.repartition(n, "home").sortWithinPartitions("home", "guest").mapInArrow(search, "point long, n long, other long")


def _points(blocks: DataFrame) -> DataFrame:
    """(key, point, rep, weight): rep is the smallest identifier, null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, keys = (batch.column(c)[i].as_py() for c in ("block", "n", "keys"))
                ids, named, weight = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "named", "weights"))
                key = pa.array([keys[k : k + 16] for k in range(0, len(keys), 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([key, pa.array(_numbers(block, n)), pa.array(ids, mask=named == 0), pa.array(weight)], ["key", "point", "rep", "weight"])

    return blocks.mapInArrow(run, "key binary, point long, rep long, weight long")


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.  ``block`` sets the
    points of a block, which else follow the number of vectors."""
    rows = usable(vectors, id_col, vec_col)
    dtype = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    sizes = rows.where("vec IS NOT NULL").groupBy("dim").agg(F.approx_count_distinct("key").alias("n")).orderBy("dim").collect()
    found = points = None
    for dim, total in sizes:
        blocks = stash(block_trees(rows.where("vec IS NOT NULL").where(F.col("dim") == dim), dim, dtype, total, block, float(np.sqrt(max(0.0, 2 - 2 * cosine)))), "blocks")
        links, own = stash(block_links(blocks, dim, dtype, cosine), "links"), _points(blocks)
        # points of different dimensions get different numbers
        shift = F.lit(dim).cast("long") * (1 << 44)
        links, own = links.select((F.col("point") + shift).alias("point"), "n", (F.col("other") + shift).alias("other")), own.withColumn("point", F.col("point") + shift)
        found, points = (links, own) if found is None else (found.union(links), points.union(own))
    named = F.col("id").isNotNull()
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    points = stash(points, "points")
    tied = components(found.where("other IS NOT NULL").select(F.col("point").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "point")
    heads = tied.join(points.select("point", "rep"), "point").groupBy("component").agg(F.min("rep").alias("head"))
    tied = tied.join(heads, "component").select("point", "head")
    counts = found.where("other IS NULL").groupBy("point").agg(F.sum("n").alias("n"))
    per = points.join(counts, "point", "left").join(tied, "point", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("head", "rep").alias("component_id")
    )
    out = rows.select("id", "key").join(per, "key", "left")
    component = F.when(named, F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (~named | (F.col("id") == component)).alias("kept"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(vec_id, other) AS (SELECT a, b FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS m FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""
