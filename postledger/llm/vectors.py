"""Near-duplicate vectors by NN-descent, with complete links inside each component."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postledger.llm.components import components
from postledger.shared import cut

THRESHOLD = 0.9
NEIGHBOURS = 8  # length of a neighbour list
ENLARGED = 4  # a list full of threshold edges may grow to this many times its length
TABLES = 6  # random orders that give the first graph
BLOCK = 256  # neighbours in an order that are compared with each other
FLOOR = 0.25  # less similar neighbours lead nowhere
SLACK = 1e-4  # single precision is trusted only this far
MAX_ROUNDS = 4
SETTLED = 0.002  # stop when a round finds less than this share of new threshold edges
TILE = 512
AUDIT_QUERIES = 400
SEED = 71


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes; NULL for vectors without a direction."""
    for batch in batches:
        out = []
        for values in batch.column(1).to_pylist():
            unit = None
            if values and None not in values:
                v = np.array(values, dtype=np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    unit = (v / np.sqrt(v @ v) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """The vectors of one length that a binary column holds."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree in the first ``keys`` columns, at most ``most`` at once.

    Rows come sorted by these columns; only one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last, size = None, 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        begin = 0
        for i in range(batch.num_rows + 1):
            end_of_run = i < batch.num_rows and (key[i] != last or size + i - begin >= most)
            if end_of_run or i == batch.num_rows:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                    size += i - begin
                begin = i
            if end_of_run:
                if held:
                    yield joined()
                held, size, last = [], 0, key[i]
    if held:
        yield joined()


def _orders(bits: int):
    """Each vector's place in every random order: side of ``bits`` planes, then a projection."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted(set(batch.column(2).to_pylist())):
                rows = batch.filter(pa.array([d == dim for d in batch.column(2).to_pylist()]))
                v = matrix(rows.column(1))
                planes = np.random.default_rng((SEED, dim)).normal(size=(TABLES, bits + 1, dim))
                single = pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary())
                for t in range(TABLES):
                    sides = v @ planes[t].T
                    code = (sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), rows.column(2), pa.array(code.astype(np.int64)), pa.array(sides[:, bits]), rows.column(0), single],
                        ["table", "dim", "code", "side", "id", "vec"],
                    )

    return place


def _edges(ids: pa.Array, pairs: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> pa.RecordBatch:
    a, b = pairs
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s.astype(np.float64))], ["v", "u", "s"])


def _first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, 2, BLOCK):
        v = matrix(run.column(5), np.float32)
        n = len(v)
        if n < 2:
            continue
        s = v @ v.T
        np.fill_diagonal(s, -2)
        k = min(NEIGHBOURS, n - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        a, b = np.repeat(np.arange(n), k), near.ravel()
        good = s[a, b] >= FLOOR
        yield _edges(run.column(4), (a[good], b[good]), s[a, b][good])


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the neighbours of one node with each other; give what improves a list."""
    for run in runs(batches, 1, BLOCK):
        n = run.num_rows
        if n < 2:
            continue
        v = matrix(run.column(4), np.float32)
        new, low = np.array(run.column(2).to_pylist(), dtype=bool), np.array(run.column(3).to_pylist())
        s = v @ v.T
        np.fill_diagonal(s, -2)
        # A list is improved by what is nearer than its last entry.
        a, b = np.nonzero((s > low[:, None]) & (new[:, None] | new[None, :]))
        if len(a):
            yield _edges(run.column(1), (a, b), s[a, b])


def _shortened(edges: DataFrame) -> DataFrame:
    """The best of every list: NEIGHBOURS entries, more only while they are threshold edges."""
    by_node = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    best = edges.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    ranked = best.withColumn("rank", F.row_number().over(by_node)).where(F.col("rank") <= NEIGHBOURS * ENLARGED)
    return ranked.where((F.col("rank") <= NEIGHBOURS) | (F.col("s") >= THRESHOLD - SLACK)).select("v", "u", "s", "new")


def neighbour_graph(nodes: DataFrame, id_type: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Directed edges ``v, u, s`` of the refined graph over rows of ``id, vec, dim``."""
    total = nodes.count()
    bits = max(1, round(math.log2(max(2, total / BLOCK * 2))))
    schema = f"v {id_type}, u {id_type}, s double"
    order = ["table", "dim", "code", "side", "id"]
    placed = nodes.select("id", "vec", "dim").mapInArrow(_orders(bits), f"table int, dim int, code long, side double, id {id_type}, vec binary")
    first = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_edges, schema)
    graph = cut(_shortened(first.withColumn("new", F.lit(True))), "nn-graph")
    singles = cut(nodes.mapInArrow(_to_single, f"id {id_type}, vec binary"), "nn-single")
    linked = F.count(F.when(F.col("s") >= THRESHOLD - SLACK, 1))
    found = graph.agg(linked).first()[0]
    for _ in range(max_rounds):
        # A short or saturated list takes anything above its floor.
        lows = graph.groupBy("v").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n"))
        saturated = (F.col("least") >= THRESHOLD - SLACK) & (F.col("n") < NEIGHBOURS * ENLARGED)
        low = F.when(F.col("n") < NEIGHBOURS, FLOOR).when(saturated, THRESHOLD - SLACK).otherwise(F.col("least"))
        members = lows.select(F.col("v").alias("member"), low.alias("low")).join(singles.withColumnRenamed("id", "member"), "member")
        met = graph.select(F.col("v").alias("hub"), F.col("u").alias("member"), "new").unionByName(
            graph.select(F.col("u").alias("hub"), F.col("v").alias("member"), "new")
        )
        met = met.groupBy("hub", "member").agg(F.max("new").alias("new"))
        around = met.join(members, "member").select("hub", "member", "new", "low", "vec")
        better = around.repartition("hub").sortWithinPartitions("hub").mapInArrow(_local_join, schema)
        # min(new): an edge that was there before is not new again.
        graph = cut(_shortened(graph.withColumn("new", F.lit(False)).unionByName(better.withColumn("new", F.lit(True)))), "nn-graph")
        now = graph.agg(linked).first()[0]
        if now - found <= SETTLED * now:
            break
        found = now
    return graph.select("v", "u", "s")


def _to_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        single = [np.frombuffer(x, dtype=np.float64).astype(np.float32).tobytes() for x in batch.column(batch.schema.get_field_index("vec")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(single, pa.binary())], ["id", "vec"])


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            good = [
                len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= THRESHOLD
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _tile_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every vector of a tile to the vectors of its other side."""
    for run in runs(batches, 3, 1 << 62):
        v, copies = matrix(run.column(6)), np.array(run.column(5).to_pylist(), dtype=np.int64)
        chunk, lo, hi = np.array(run.column(3).to_pylist()), run.column(1)[0].as_py(), run.column(2)[0].as_py()
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        linked = v[left] @ v[right].T >= THRESHOLD
        n = np.zeros(len(v), dtype=np.int64)
        if lo == hi:
            np.fill_diagonal(linked, False)
            n[left] = linked @ copies[right]
        else:
            n[left], n[right] = linked @ copies[right], linked.T @ copies[left]
        yield pa.RecordBatch.from_arrays([run.column(4), pa.array(n)], ["id", "n"])


def links_in_components(nodes: DataFrame, roots: DataFrame, id_type: str) -> DataFrame:
    """``id, n``: how many vectors of its component each vector links with, all of them.

    A component is cut into chunks of about TILE vectors; every pair of chunks is one
    tile, and tiles give counts, not pairs. So lists that were saturated are completed.
    """
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks"))
    placed = roots.join(sizes, "root").join(nodes, F.col("node") == F.col("id"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "copies", "vec")
    key = ["root", "lo", "hi"]
    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(_tile_counts, f"id {id_type}, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Equal directions collapse to their smallest id first, so copies never meet in the
    search. NN-descent starts from the neighbours in a few random orders and
    compares, in each round, the neighbours of every node with each other; a list full
    of threshold edges may grow. Edges are checked in double precision, components are
    closed over them, and inside a component all links are counted, so every link
    between vectors of one component is found. See :func:`audit_recall`.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows
    with a NULL id, link with nothing: no links, the own id as component, kept. Vectors
    of different lengths never link. Repeated rows are vectors of their own, of one id.
    An empty table gives an empty table; other columns are not read.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    units = rows.mapInArrow(_units, f"id {id_type}, vec binary").withColumn("same", F.when(F.col("id").isNotNull(), F.md5("vec")))
    units = cut(units, "nn-units")
    nodes = (
        units.where("same is not null")
        .groupBy("same")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .withColumn("dim", (F.length("vec") / 8).cast("int"))
    )
    nodes = cut(nodes, "nn-nodes")
    graph = neighbour_graph(nodes, id_type, max_rounds)
    near = graph.where(F.col("s") >= THRESHOLD - SLACK).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    pairs = near.join(nodes.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
    links = cut(pairs.select("a", "b", "x", "y").mapInArrow(_exact_links, f"a {id_type}, b {id_type}"), "nn-links")
    roots = components(links)
    counted = links_in_components(nodes.select("id", "copies", "vec"), roots, id_type)
    decided = (
        nodes.select("id", "same", "copies")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .join(counted, "id", "left")
        .select("same", F.coalesce("root", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    component: Column = F.coalesce("root", "id")
    return units.select("id", "same").join(decided, "same", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def audit_recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = AUDIT_QUERIES) -> float:
    """Share of the true links of up to ``queries`` vectors that ``n_links`` of ``found`` has.

    The queries are the vectors whose ids hash lowest; all rows are compared with
    them by brute force in blocks.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    units = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_units, f"id {id_type}, vec binary").where("vec is not null and id is not null")
    asked = units.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    if not asked:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["vec"])) for r in asked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            held = batch.column(1).to_pylist()
            for size in {len(x) for x in held}:
                v = matrix(pa.array([x for x in held if len(x) == size], pa.binary()))
                at = [i for i, (_, q) in enumerate(shared.value) if len(q) == size]
                if at:
                    n[at] += (np.stack([np.frombuffer(shared.value[i][1]) for i in at]) @ v.T >= THRESHOLD).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in shared.value]), pa.array(n)], ["id", "n"])

    # Each query meets itself once.
    true = units.mapInArrow(count, f"id {id_type}, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(found, F.col("id") == F.col("vec_id")).agg(F.sum(F.least("n", "n_links")).alias("hit"), F.sum("n").alias("all")).first()
    return both["hit"] / both["all"] if both["all"] else 1.0
