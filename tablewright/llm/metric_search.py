"""Exact top-k inner products by best-first search in an M-tree.

Vectors become integers, floor(64 * x). A larger inner product is a smaller Euclidean distance
once every candidate v gets one more coordinate sqrt(M - |v|^2), M being the largest squared norm,
and every query a zero: then |q - v|^2 = |q|^2 + M - 2 q.v, a metric in which an M-tree can prune.

The tree has three levels of nodes. Under the root stand at most ``PIVOTS`` cells; their pivots are
chosen from at most ``SAMPLE`` rows (those with the smallest hash), but every vector goes to the
cell of its nearest pivot. A cell's vectors are dealt to pages of about ``PAGE`` rows, so a hot
cell is many pages, and the vectors of a page are split into leaves of at most ``LEAF`` entries. A
cell keeps its covering radius; a leaf its routing vector, covering radius and distance to the
cell's pivot; an entry its distance to the routing vector. The nodes are stored once.

A query first searches its own cell, which gives a bound on its k-th score, then those other cells
whose pivot and radius cannot exclude a better entry. In a page, leaves whose stored parent
distance already exceeds the bound are dropped without a computation; the others are visited in
order of their least possible distance until that exceeds the bound, in waves; in a leaf the stored
distance of an entry saves its computation in the same way. Comparisons leave room for rounding
and for ties, scores are computed in exact integers. Queries and pages meet in blocks of bounded
size, so neither a page nor the queries of a page are gathered without limit.

Vectors with a component of 2**24 or more after scaling are too wide for distances in doubles. They stay
out of the tree and meet the others in blocks: all queries with the wide vectors, the wide queries with
all vectors. There doubles with an error bound leave out what cannot be among the best of a block, and
the rest is scored in Python's unbounded integers.

Results: ties go to the smaller id. A vector that is null or holds a null or a non-finite component
takes no part; every other one does, however large. A score beyond 64 bits, which a long cannot hold,
counts as the largest or smallest long. Shorter vectors count as padded with
zeros. A query's own row, and any other row of its id, is not its candidate. Repeated query rows
count once, repeated candidates each. A null id is smaller than all others and never a query. An
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, quoted

SCALE, LARGEST = 64, 1 << 24
PIVOTS, SAMPLE, PAGE, LEAF = 32, 2048, 4096, 64
QUERY_BLOCK = 512
NO_ID = -(1 << 63)  # stands for a null id


# --- vectors -------------------------------------------------------------------------------

def whole_numbers(vector: Column) -> Column:
    """floor(64 * x) of each component; null for vectors that take no part in the tree."""
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    fit = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))
    return F.when(fit, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def is_wide(vector: Column) -> Column:
    """Whether a vector takes part but is too wide for the tree."""
    each = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(each, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(each, lambda x: F.abs(x) * SCALE >= LARGEST), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors (as bytes of 32-bit integers) as a matrix of doubles."""
    data = b"".join(x.ljust(4 * width, b"\0") for x in column.to_pylist())
    return np.frombuffer(data, "<i4").reshape(len(column), width).astype(np.float64)


class Space:
    """Distances among candidates and from queries to candidates, for a largest squared norm."""

    def __init__(self, largest: int) -> None:
        self.largest = float(largest)
        self.slack = 1e-9 * (1.0 + self.largest) ** 0.5 + 1e-6
        self.exact = largest < 1 << 53

    def extra(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (rows * rows).sum(axis=-1), 0.0))

    def between(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Distances of candidates (rows) to candidates (columns)."""
        inner = rows @ to.T + np.outer(self.extra(rows), self.extra(to))
        return np.sqrt(np.maximum(2 * self.largest - 2 * inner, 0.0))

    def from_scores(self, norm: float, scores: np.ndarray | float) -> np.ndarray:
        """Distances of a query of squared norm ``norm`` to candidates of these scores."""
        return np.sqrt(np.maximum(norm + self.largest - 2 * scores, 0.0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; sums beyond the whole numbers of doubles go by 64-bit integers."""
        if self.exact:
            return rows @ query
        return (rows.astype(np.int64) @ query.astype(np.int64)).astype(np.int64)


def choose_pivots(sample: np.ndarray, space: Space, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    picked = [0]
    near = space.between(sample, sample[:1])[:, 0]
    while len(picked) < most and near.max() > space.slack:
        picked.append(int(near.argmax()))
        near = np.minimum(near, space.between(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


# --- nodes ---------------------------------------------------------------------------------

def split_leaves(rows: np.ndarray, space: Space, most: int = LEAF) -> list[np.ndarray]:
    """Index sets of at most ``most`` rows, by halving between two distant rows."""
    todo, leaves = [np.arange(len(rows))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            leaves.append(part)
            continue
        first = part[space.between(rows[part], rows[part[:1]])[:, 0].argmax()]
        to_first = space.between(rows[part], rows[[first]])[:, 0]
        second = part[to_first.argmax()]
        gap = to_first - space.between(rows[part], rows[[second]])[:, 0]
        order = np.argsort(gap, kind="stable")
        # Between a fifth and four fifths, so that the tree stays shallow under equal rows too.
        cut = int(np.clip((gap < 0).sum(), len(part) // 5 + 1, len(part) - len(part) // 5 - 1))
        todo += [part[order[:cut]], part[order[cut:]]]
    return leaves


NODE = "cell int, page int, routing binary, radius double, parent double, ids array<long>, vectors binary, distances array<double>"


def _build(space: Space, pivots: np.ndarray):
    width = pivots.shape[1]

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, page = (k.as_py() for k in key)
        ids = table["id"].to_numpy()
        rows = _matrix(table["v"].combine_chunks(), width)
        out = {name: [] for name in ("cell", "page", "routing", "radius", "parent", "ids", "vectors", "distances")}
        for leaf in split_leaves(rows, space):
            members = rows[leaf]
            middle = members - members.mean(axis=0)
            routing = members[[(middle * middle).sum(axis=1).argmin()]]
            far = space.between(members, routing)[:, 0]
            values = (
                cell, page, routing.astype("<i4").tobytes(), float(far.max()),
                float(space.between(routing, pivots[[cell]])[0, 0]), ids[leaf], members.astype("<i4").tobytes(), far,
            )
            for name, value in zip(out, values):
                out[name].append(value)
        kinds = {"cell": pa.int32(), "page": pa.int32(), "routing": pa.binary(), "vectors": pa.binary(),
                 "ids": pa.list_(pa.int64()), "distances": pa.list_(pa.float64())}
        return pa.table({name: pa.array(values, kinds.get(name, pa.float64())) for name, values in out.items()})

    return build


# --- search --------------------------------------------------------------------------------

@dataclass
class Page:
    """The leaves of one page: routing vectors, radii and parent distances, the number of
    entries of each leaf, and the entries of all leaves one after the other."""

    routing: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    distances: np.ndarray


WAVE = 4  # leaves visited at first; each wave takes twice as many as the one before


def search_page(
    page: Page, query: np.ndarray, own: int, bound: float | None, to_pivot: float, k: int, space: Space
) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ``k`` scores and ids of one page, and the number of distances computed.

    ``bound`` is a score that better entries must reach. Leaves are visited in order of their
    least possible distance, in waves between which the bound is drawn closer.
    """
    norm = float(query @ query)
    reach = np.inf if bound is None else float(space.from_scores(norm, bound)) + space.slack
    near = np.flatnonzero(np.abs(to_pivot - page.parent) - page.radius <= reach)
    to_routing = np.full(len(page.radius), np.inf)
    to_routing[near] = space.from_scores(norm, page.routing[near] @ query)
    computed = len(near)
    least = to_routing - page.radius
    waiting = near[np.argsort(least[near], kind="stable")]
    best, ids, width = np.empty(0, np.int64), np.empty(0, np.int64), WAVE
    while len(waiting):
        now, waiting = waiting[:width], waiting[width:]
        now, width = now[least[now] <= reach], 2 * width
        if not len(now):
            break
        open_ = np.zeros(len(least), bool)
        open_[now] = True
        at = np.flatnonzero(np.repeat(open_, page.sizes))
        gap = np.abs(np.repeat(to_routing, page.sizes)[at] - page.distances[at])
        at = at[(gap <= reach) & (page.ids[at] != own)]
        computed += len(at)
        scores = space.scores(page.vectors[at], query).astype(np.int64)
        if len(scores) > k:
            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[good], scores[good]
        best, ids = np.concatenate((best, scores)), np.concatenate((ids, page.ids[at]))
        order = np.lexsort((ids, -best))[:k]
        best, ids = best[order], ids[order]
        if len(best) == k:
            reach = min(reach, float(space.from_scores(norm, float(best[-1]))) + space.slack)
    return best, ids, computed


FOUND = "q long, query_id long, vec_id long, score long"


def _search(space: Space, pivots: np.ndarray, k: int):
    width = pivots.shape[1]

    def search(key: tuple[pa.Scalar, ...], queries: pa.Table, nodes: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(queries) and len(nodes):
            pivot = pivots[key[0].as_py()]
            entries = [np.frombuffer(v, "<i4") for v in nodes["vectors"].to_pylist()]
            page = Page(
                _matrix(nodes["routing"].combine_chunks(), width), nodes["radius"].to_numpy(), nodes["parent"].to_numpy(),
                np.array([len(v) // width for v in entries]), nodes["ids"].combine_chunks().flatten().to_numpy(),
                np.concatenate(entries).reshape(-1, width).astype(np.float64),
                nodes["distances"].combine_chunks().flatten().to_numpy(),
            )
            rows = _matrix(queries["v"].combine_chunks(), width)
            for row, q, own, bound in zip(rows, *(queries[n].to_pylist() for n in ("q", "id", "bound"))):
                to_pivot = float(space.from_scores(float(row @ row), float(pivot @ row)))
                best, ids, _ = search_page(page, row, own, bound, to_pivot, k, space)
                for part, values in zip(out, (np.full(len(ids), q), np.full(len(ids), own), ids, best)):
                    part.append(values)
        flat = [np.concatenate(part).astype(np.int64) if part else np.empty(0, np.int64) for part in out]
        return pa.table(dict(zip(("q", "query_id", "vec_id", "score"), map(pa.array, flat))))

    return search


# --- wide vectors --------------------------------------------------------------------------

WIDE_BLOCK = 4096
TOP = (1 << 63) - 1


def _integers(data: bytes, wide: bool) -> list[int]:
    """Scaled components of a packed vector: 32-bit integers, or doubles yet to be scaled."""
    if not wide:
        return np.frombuffer(data, "<i4").tolist()
    return [math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in np.frombuffer(data, "<f8").tolist()]


def _exact_best(query: list[int], rows: list[list[int]], near: np.ndarray, k: int, own: int, ids: np.ndarray) -> list[tuple[int, int]]:
    """The best ``k`` of (score, id), from exact scores; those beyond a long are the largest or smallest one."""
    with np.errstate(all="ignore"):
        point = np.zeros(near.shape[1])
        point[: len(query)] = [float(x) if abs(x) < 1 << 1000 else np.inf for x in query[: len(point)]]
        about = near @ point
        error = (np.abs(near) @ np.abs(point)) * (len(point) + 4) * 2.0**-50
    at = np.flatnonzero(ids != own)
    with np.errstate(invalid="ignore"):
        held = bool((np.abs(about) + error < 2.0**62).all())
    if len(at) > k and held:
        floor = np.partition((about - error)[at], len(at) - k)[len(at) - k]
        at = at[(about + error)[at] >= floor]
    scored = [(max(-TOP - 1, min(TOP, sum(a * b for a, b in zip(query, rows[n])))), int(ids[n])) for n in at.tolist()]
    return sorted(scored, key=lambda x: (-x[0], x[1]))[:k]


def _search_wide(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(candidates):
            rows = [_integers(v, w) for v, w in zip(candidates["v"].to_pylist(), candidates["wide"].to_pylist())]
            near = np.zeros((len(rows), max(1, max(map(len, rows)))))
            for place, row in zip(near, rows):
                place[: len(row)] = [float(x) if abs(x) < 1 << 1000 else np.inf for x in row]
            ids = candidates["id"].to_numpy()
            for q, own, v, wide in zip(*(queries[n].to_pylist() for n in ("q", "id", "v", "wide"))):
                best = _exact_best(_integers(v, wide), rows, near, k, own, ids)
                out += [(q, own, i, score) for score, i in best]
        columns = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["q", "query_id", "vec_id", "score"])

    return search


def _wide_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` candidates in each block of them for each query: ``queries`` q, id, v, wide; ``candidates`` id, v, wide, row."""
    many, asked = candidates.count(), queries.count()
    of, blocks = max(1, -(-many // WIDE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q", "id", "v", "wide", block("q", blocks).alias("block"), every(of).alias("part"))
    right = candidates.select("id", "v", "wide", block("row", of).alias("part"), every(blocks).alias("block"))
    keys = ["part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_wide(k), FOUND)


def top_products(
    vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the queries, rows whose id is divisible by ``every``."""
    spark = prepare(vectors.sparkSession)
    named = vectors.select(F.coalesce(quoted(id).cast("long"), F.lit(NO_ID)).alias("id"), quoted(vector).alias("x"))
    named = named.withColumn("row", F.monotonically_increasing_id())
    rows = named.select("id", "row", whole_numbers(F.col("x")).alias("w"))
    packed = _pack("<i4")
    rows = rows.where("w IS NOT NULL").select(
        "id", packed(F.col("w")).alias("v"), F.size("w").alias("width"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x).alias("norm"),
        "row",
    )
    rows = rows.checkpoint()
    doubles = _pack("<f8")
    wide = named.where(is_wide(F.col("x"))).select("id", "row", doubles(F.transform("x", lambda x: x.cast("double"))).alias("v"), F.lit(True).alias("wide")).checkpoint()
    is_query = (F.col("id") % every == 0) & (F.col("id") != NO_ID)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    shown = lambda found: ranked(found).select(
        "query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score"
    )
    shape = rows.agg(F.max("width").alias("width"), F.max("norm").alias("norm"), F.count("*").alias("n")).first()
    numbered = lambda asked: asked.select(F.xxhash64("id", "v").alias("q"), "id", "v").distinct()
    wide_queries = numbered(wide.where(is_query)).withColumn("wide", F.lit(True))
    in_tree = rows.select("id", "v", F.lit(False).alias("wide"), "row")
    # Wide queries meet all vectors, the others the wide ones.
    by_blocks = None
    if not wide.isEmpty():
        plain_queries = numbered(rows.where(is_query)).withColumn("wide", F.lit(False))
        candidates = in_tree.unionByName(wide)
        by_blocks = _wide_products(wide_queries, candidates, k).unionByName(_wide_products(plain_queries, wide, k))
    if not shape["n"]:
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        return empty if by_blocks is None else shown(by_blocks)
    space, width = Space(shape["norm"]), max(1, shape["width"])
    sample = rows.orderBy(F.xxhash64("v", "id"), "v").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(_matrix(pa.array([bytes(r.v) for r in sample]), width), space)

    # Every vector to the cell of its nearest pivot, every cell to pages.
    placed = rows.withColumn("place", _nearest(space, pivots)("v")).select("id", "v", "row", "place.*").checkpoint()
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # PIVOTS rows at most
    pages = {c.cell: -(-c.n // PAGE) for c in cells}
    dealt = F.create_map(*[F.lit(x) for pair in pages.items() for x in pair])
    number = F.pmod(F.xxhash64("row"), dealt[F.col("cell")]).cast("int")
    nodes = placed.withColumn("page", number).groupBy("cell", "page").applyInArrow(_build(space, pivots), NODE).checkpoint()

    queries = numbered(placed.where(is_query)).withColumn("home", _home(space, pivots)("v")).checkpoint()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod("q", F.lit(blocks)).cast("int").alias("block")
    spread = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: q, id, v, bound, cell."""
        sent = asked.select("*", block, F.explode(F.sequence(F.lit(0), dealt[F.col("cell")] - 1)).alias("page"))
        keys = ["cell", "page", "block"]
        return sent.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_search(space, pivots, k), FOUND)

    none = F.lit(None).cast("long")
    at_home = searched(queries.select("q", "id", "v", none.alias("bound"), F.col("home").alias("cell")))
    at_home = ranked(at_home).drop("rank").checkpoint()
    bounds = at_home.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    radii = {c.cell: c.radius for c in cells}
    open_cells = _open_cells(space, pivots, radii)
    others = queries.join(bounds, "q", "left").select("q", "id", "v", "bound", F.explode(open_cells("v", "bound", "home")).alias("cell"))
    found = at_home.unionByName(searched(others))
    return shown(found if by_blocks is None else found.unionByName(by_blocks))


def _pack(kind: str):
    """Vectors as bytes of little-endian numbers."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.dtype(kind).itemsize
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))) * size
        return pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return packed


def _nearest(space: Space, pivots: np.ndarray):
    @F.arrow_udf("cell int, far double")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            to = space.between(_matrix(batch, pivots.shape[1]), pivots)
            cell = to.argmin(axis=1)
            far = to[np.arange(len(cell)), cell]
            yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(far)], names=["cell", "far"])

    return nearest


def _home(space: Space, pivots: np.ndarray):
    @F.arrow_udf("int")
    def home(batch: pa.Array) -> pa.Array:
        return pa.array((_matrix(batch, pivots.shape[1]) @ pivots.T).argmax(axis=1), pa.int32())

    return home


def _open_cells(space: Space, pivots: np.ndarray, radii: dict[int, float]):
    reach_of = np.array([radii.get(n, -np.inf) for n in range(len(pivots))])

    @F.arrow_udf("array<int>")
    def cells(v: pa.Array, bound: pa.Array, home: pa.Array) -> pa.Array:
        rows, out = _matrix(v, pivots.shape[1]), []
        for row, least, own in zip(rows, bound.to_pylist(), home.to_pylist()):
            norm = float(row @ row)
            reach = np.inf if least is None else float(space.from_scores(norm, least)) + space.slack
            open_ = space.from_scores(norm, pivots @ row) - reach_of <= reach
            open_[own] = False
            out.append(np.flatnonzero(open_ & np.isfinite(reach_of)).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return cells
