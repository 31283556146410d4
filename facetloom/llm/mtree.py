"""Exact top-k inner products by best-first search in an M-tree.

Vectors are dealt to cells, each to its nearest of at most ``MAX_CELLS`` pivots (farthest points of a bounded sample), and
sorted by cell; a cell of many rows goes to several tasks. Tasks cut them into pages of at most ``page`` objects, so that
a page lies close together. A page is a subtree of three levels: a root with a covering radius; inner nodes and leaves
with a routing object, a covering radius and the distance to the node above; objects with their distance to the leaf's
routing object. The headers of pages are the upper nodes; they stand in chunks of ``HEADERS``, which queries meet in blocks.

The metric is Euclidean; by Cauchy-Schwarz, q.o <= q.c + |q| d(c, o), so distances bound inner products: a page by
q.c + |q| R, a node by q.parent + |q| (d(node, parent) + r) before its own routing object is ever looked at, an object by
q.leaf + |q| d(o, leaf) before its own product is computed.

Queries first search the page with the best bound, which gives each a threshold, then, in blocks of
``QUERY_BLOCK``, all other pages whose bound reaches it. Bounds are kept with a margin above rounding errors, ties are never pruned,
and scores are integers, so the result is exact. Where vectors have no structure (distances all but equal) bounds prune
little and every query meets nearly every page; the work is then queries times vectors, as it must be.

Defined results: rows whose id is null, or whose vector is null, empty, or holds a null or non-finite component, take no part;
vectors are only compared with those of the same dimension; every row is a query or a candidate of its own, also where ids
or whole rows repeat, and is no candidate of itself alone; without candidates a query has no rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.common import forget, stored, table, tidy

PAGE, LEAF, QUERY_BLOCK, HEADERS = 4096, 256, 512, 4096
MAX_CELLS, PIVOT_SAMPLE = 512, 4096
SCALE = 256.0
OBJECTS = "uid long, id long, dim int, x binary, is_query boolean"
PAGES = "page long, dim int, n int, center binary, radius double, tree binary"


def scaled(batch_column) -> tuple[list, list]:
    """Row numbers and integer vectors floor(256 x) of the rows that take part."""
    rows, vectors = [], []
    for i, v in enumerate(batch_column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                rows.append(i)
                vectors.append(np.floor(SCALE * x).astype(np.int64))
    return rows, vectors


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def farthest(x: np.ndarray, n: int, start: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """At most ``n`` pivots, each the point farthest from those before; of each point its nearest pivot, and its distance."""
    pivots, owner, near = [int(np.argmax(distances(x, start)))], np.zeros(len(x), int), np.full(len(x), np.inf)
    while True:
        d = distances(x, x[pivots[-1]])
        closer = d < near
        owner[closer], near[closer] = len(pivots) - 1, d[closer]
        if len(pivots) == n or near.max() == 0:
            return pivots, owner, near
        pivots.append(int(np.argmax(near)))


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """One page: root, about the square root of the number of leaves as inner nodes, and leaves of at most ``leaf`` objects.

    ``ids``: two columns, id and row number."""
    f = x.astype(np.float64)
    root = f.mean(0)
    pivots, owner, near = farthest(f, max(1, -(-len(x) // leaf)), root)
    leaves = []
    for k, p in enumerate(pivots):
        at = np.flatnonzero(owner == k)
        order = at[np.lexsort((ids[at, 0], near[at]))]
        # equal or very close objects fill several leaves of one routing object
        for lo in range(0, len(order), leaf):
            part = order[lo : lo + leaf]
            leaves.append({"route": f[p], "radius": float(near[part].max()), "ids": ids[part], "x": x[part], "d": near[part]})
    routes = np.stack([n["route"] for n in leaves])
    tops, under, away = farthest(routes, max(1, round(len(leaves) ** 0.5)), root)
    inner = []
    for k, p in enumerate(tops):
        below = [leaves[i] | {"parent": float(away[i])} for i in np.flatnonzero(under == k)]
        inner.append({"route": routes[p], "radius": max(n["parent"] + n["radius"] for n in below), "parent": float(distances(routes[p], root)), "below": below})
    return {"root": root, "radius": float(distances(f, root).max()), "inner": inner}


def search(tree: dict, q: np.ndarray, own: int, k: int, worst: int | None) -> list[tuple[int, int]]:
    """The k best (score, id) of one page, ties to smaller ids; scores below ``worst`` are of no use."""
    norm, at_root = float(np.sqrt((q.astype(np.float64) ** 2).sum())), float(q @ tree["root"])
    slack = 1e-9 * (1 + abs(at_root) + norm * (tree["radius"] + 1))
    best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst kept on top
    limit = -np.inf if worst is None else worst
    # bounded through the parent's product first, and when its turn comes, through its own routing object
    queue = [(-(at_root + norm * (n["parent"] + n["radius"]) + slack), i, None, n) for i, n in enumerate(tree["inner"])]
    heapq.heapify(queue)
    serial = len(queue)
    while queue:
        bound, _, routed, node = heapq.heappop(queue)
        if -bound < limit:
            break
        if routed is None:
            routed = float(q @ node["route"])
            heapq.heappush(queue, (-(routed + norm * node["radius"] + slack), serial := serial + 1, routed, node))
            continue
        if "below" in node:
            for n in node["below"]:
                heapq.heappush(queue, (-(routed + norm * (n["parent"] + n["radius"]) + slack), serial := serial + 1, None, n))
            continue
        use = np.flatnonzero(routed + norm * node["d"] + slack >= limit)
        scores = node["x"][use] @ q
        use = use[scores >= limit]
        for (o, row), score in zip(node["ids"][use].tolist(), scores[scores >= limit].tolist()):
            if row != own:
                if len(best) < k:
                    heapq.heappush(best, (score, -o))
                elif (score, -o) > best[0]:
                    heapq.heapreplace(best, (score, -o))
        if len(best) == k:
            limit = max(limit, best[0][0])
    return [(s, -o) for s, o in best]


def _columns(rows, names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [n.split() for n in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


class MTreeIndex:
    """``fit`` builds and stores the tree of every row; ``top`` answers the rows that are queries."""

    def __init__(self, page: int = PAGE, leaf: int = LEAF, cells: int = MAX_CELLS, headers: int = HEADERS):
        self.page, self.leaf, self.cells, self.headers = page, leaf, cells, headers
        self.objects = self.pages = None

    def fit(self, vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding") -> "MTreeIndex":
        page, leaf = self.page, self.leaf

        def number(batches):
            import pyspark

            uid = pyspark.TaskContext.get().partitionId() << 33
            for batch in batches:
                keys, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                rows = [(uid + n, keys[i], len(x), x.tobytes(), bool(asked[i])) for n, (i, x) in enumerate(zip(*scaled(batch.column(1))))]
                uid += len(rows)
                if rows:
                    yield _columns(rows, OBJECTS)

        known = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), vector, is_query)
        self.objects = stored(known.mapInArrow(tidy(number), OBJECTS))
        total = self.objects.count()
        cells = max(1, min(self.cells, total // page))
        share = min(1.0, PIVOT_SAMPLE / max(total, 1))
        sample: dict[int, list] = {}
        for r in self.objects.select("dim", "x").sample(fraction=share, seed=5).limit(2 * PIVOT_SAMPLE).collect() if cells > 1 else []:
            sample.setdefault(r["dim"], []).append(np.frombuffer(bytes(r["x"]), np.int64).astype(np.float64))
        pivots = {}
        for dim, xs in sample.items():
            f = np.stack(xs)
            pivots[dim] = f[farthest(f, cells, f.mean(0))[0]]
        shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_CELLS vectors a dimension

        def deal(batches):
            for batch in batches:
                cell = []
                for x in batch.column(3).to_pylist():
                    x = np.frombuffer(x, np.int64)
                    own = shared.value.get(len(x))
                    cell.append(0 if own is None else int(np.argmin((own**2).sum(1) - 2 * own @ x)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell, pa.int32())], ["uid", "id", "dim", "x", "cell"])

        def grow(batches):
            import pyspark

            task, made, held = pyspark.TaskContext.get().partitionId(), 0, []

            def emit():
                nonlocal made, held
                ids = np.array([(r[1], r[0]) for r in held], np.int64)
                tree = build(ids, np.stack([np.frombuffer(r[3], np.int64) for r in held]), leaf)
                made += 1
                row = ((task << 32) + made, held[0][2], len(held), tree["root"].tobytes(), tree["radius"], pickle.dumps(tree, 5))
                held = []
                return _columns([row], PAGES)

            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    # a page holds one dimension, and one cell unless that is small
                    if held and (len(held) == page or r[2] != held[0][2] or r[4] != held[-1][4] and len(held) >= page // 4):
                        yield emit()
                    held.append(r)
            if held:
                yield emit()

        dealt = self.objects.mapInArrow(tidy(deal), "uid long, id long, dim int, x binary, cell int")
        order = ["dim", "cell", "uid"]
        self.pages = stored(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(grow), PAGES))
        return self

    def _chunks(self) -> tuple[DataFrame, int]:
        """The headers of pages, ``headers`` to a chunk, and the number of chunks."""
        n = max(1, -(-self.pages.count() // self.headers))
        heads = self.pages.select(F.pmod(F.xxhash64("page"), F.lit(n)).cast("int").alias("chunk"), F.struct("page", "dim", "center", "radius").alias("h"))
        return stored(heads.groupBy("chunk").agg(F.collect_list("h").alias("heads"))), n

    def _bounds(self, blocks: DataFrame, chunks: DataFrame, n: int, first: bool) -> DataFrame:
        """Per query and chunk the page with the best bound (``first``), or per page and block the queries that must search it."""

        def run(batches):
            for batch in batches:
                for queries, heads in zip(batch.column("queries").to_pylist(), batch.column("heads").to_pylist()):
                    pages, dims, radii = (np.array([h[c] for h in heads]) for c in ("page", "dim", "radius"))
                    centers = {d: np.stack([np.frombuffer(h["center"], np.float64) for h in heads if h["dim"] == d]) for d in set(dims.tolist())}
                    best, found = [], {}
                    for q in queries:
                        x = np.frombuffer(q["x"], np.int64)
                        at = np.flatnonzero(dims == len(x))
                        if not len(at):
                            continue
                        bound = centers[len(x)] @ x + np.sqrt((x.astype(np.float64) ** 2).sum()) * radii[at]
                        bound += 1e-9 * (1 + np.abs(bound))
                        if first:
                            i = int(np.argmax(bound))
                            best.append((q["q"], float(bound[i]), int(pages[at[i]])))
                        else:
                            go = at[(bound >= (-np.inf if q["worst"] is None else q["worst"])) & (pages[at] != (-1 if q["done"] is None else q["done"]))]
                            for page in pages[go].tolist():
                                found.setdefault(page, []).append((q["q"], q["x"], q["worst"]))
                    if best:
                        yield _columns(best, "q long, bound double, page long")
                    for page, block in found.items():
                        yield _columns([(page, pickle.dumps(block, 5))], "page long, block binary")

        met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(chunks, "chunk")
        return met.select("queries", "heads").mapInArrow(tidy(run), "q long, bound double, page long" if first else "page long, block binary")

    def _blocks(self, queries: DataFrame, total: int) -> DataFrame:
        """Queries (q, x, worst, done), about ``QUERY_BLOCK`` to a row."""
        n = max(1, -(-total // QUERY_BLOCK))
        return queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("q", "x", "worst", "done")).alias("queries")).select("queries")

    def _search(self, routed: DataFrame, k: int) -> DataFrame:
        def run(batches):
            at, tree = None, None
            for batch in batches:
                for i, page in enumerate(batch.column("page").to_pylist()):
                    if page != at:
                        at, tree = page, pickle.loads(batch.column("tree")[i].as_py())
                    rows = [(q, page, o, s) for q, x, worst in pickle.loads(batch.column("block")[i].as_py()) for s, o in search(tree, np.frombuffer(x, np.int64), q, k, worst)]
                    if rows:
                        yield _columns(rows, "q long, page long, vec_id long, score long")

        joined = routed.join(self.pages.select("page", "tree"), "page").select("page", "block", "tree")
        return joined.mapInArrow(tidy(run), "q long, page long, vec_id long, score long")

    def top(self, k: int) -> DataFrame:
        """query_id, rank, vec_id, score of the k best for each row that is a query."""
        nothing = F.lit(None).cast("long")
        queries = self.objects.where("is_query").select(F.col("uid").alias("q"), "id", "x")
        total = queries.count()
        chunks, n = self._chunks()
        bare = queries.select("q", "x", nothing.alias("worst"), nothing.alias("done"))
        nearest = self._bounds(self._blocks(bare, total), chunks, n, True).groupBy("q").agg(F.max_by("page", F.struct("bound", "page")).alias("page"))
        packed = pickled(queries.join(nearest, "q").select("page", "q", "x"))
        seeds = stored(self._search(packed, k))
        # the k-th best so far; with fewer than k there is no threshold
        worst = seeds.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"), F.min("page").alias("done"))
        second = stored(self._bounds(self._blocks(queries.select("q", "x").join(worst, "q", "left"), total), chunks, n, False))
        others = stored(self._search(second, k))
        forget(second, chunks)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = seeds.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pickled(rows: DataFrame) -> DataFrame:
    """(page, block) of rows (page, q, x): those of a page in blocks of at most ``QUERY_BLOCK``."""

    def run(batches):
        for batch in batches:
            found: dict[int, list] = {}
            for page, q, x in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(page, []).append((q, x, None))
            for page, block in found.items():
                for lo in range(0, len(block), QUERY_BLOCK):
                    yield _columns([(page, pickle.dumps(block[lo : lo + QUERY_BLOCK], 5))], "page long, block binary")

    return rows.mapInArrow(tidy(run), "page long, block binary")


def op9_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return MTreeIndex().fit(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).top(5)


QUERIES = {"op9_mtree_topk": op9_mtree_topk}
ORACLES = {
    "op9_mtree_topk": """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
    SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5"""
}
