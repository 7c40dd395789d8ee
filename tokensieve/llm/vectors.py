"""Embedding near-deduplication on a robust-pruned flat graph.

Equal vectors are one node. Spherical k-means on a bounded sample gives centres; every node resides in the shards of
its OVERLAP nearest centres, and a shard larger than SHARD is dealt into blocks. Each block builds its graph: a node's
pool (its nearest and some random residents) is robust-pruned, and a node that the medoid can't reach gets an edge.
A node's lists from all its blocks are united. Then every resident of a block is searched for in the block, and in the
other blocks of its shard, which search it in their turn: a beam moves greedily from the medoid along the united lists, and from where it ends the
search widens over all nodes within range. Only the cosines of what a search visits are computed, in double precision. A
search that misses the node itself, though it resides there, runs again with a wider beam. A pair that meets in several
shards counts in the first that both share.

Recall is audited against all nodes for a bounded sample of queries, more of them while these have few links; if it falls
short, nodes get more shards, and where they are in all of them the beam grows, and the search runs again.

A block task sees at most SHARD residents and SHARD queries: of a large shard each pair of blocks meets once, without
emitting pairs; a task returns a count per node and a spanning forest of the links it found. Vectors of different
dimensions never meet: each dimension is a graph of its own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.components import components

THRESHOLD = 0.9
#: Residents of a block, centres at most, vectors in the k-means sample (so many, or PER_CENTRE for each centre), shards of a
#: node to begin with.
SHARD, CENTRES, SAMPLE, PER_CENTRE, OVERLAP = 2048, 16_384, 16_384, 4, 4
#: Graph: nearest and random members of a pool, degree, and how much nearer a neighbour must be to shadow another.
NEAREST, RANDOM, DEGREE, ALPHA = 24, 16, 16, 1.2
#: Search: width of the beam; the search widens over nodes of at least this cosine.
BEAM, WIDEN = 12, 0.8
#: Audit: queries to begin with and at most, the links that they should have, and the recall to reach.
AUDIT, MOST_AUDIT, SOME_LINKS, RECALL = 512, 4096, 200, 0.9999
#: Cosines computed at once.
PAIRS = 1 << 16


def centres_of(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors x, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(8):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def prune(sims: np.ndarray, pool: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours (rows of DEGREE indices, -1 to fill) from pools sorted by own similarity.

    sims: all similarities; pool: candidates of each node; own: their similarities to the node. A candidate goes when
    a chosen one is ALPHA times nearer to it than the node is.
    """
    n = len(pool)
    alive = pool != np.arange(n)[:, None]
    out = np.full((n, DEGREE), -1, np.int32)
    every = np.arange(n)
    far = np.sqrt(np.maximum(0, 2 - 2 * own))
    for d in range(DEGREE):
        first = alive.argmax(1)
        some = alive[every, first]
        if not some.any():
            break
        chosen = pool[every, first]
        out[some, d] = chosen[some]
        shadow = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * sims[chosen[:, None], pool])) <= far
        alive &= ~(shadow & some[:, None])
        alive[every, first] = False
    return out


def graph(x: np.ndarray, seed: int) -> np.ndarray:
    """The neighbour lists of a block; every node can be reached from the medoid."""
    n = len(x)
    if n == 1:
        return np.full((1, DEGREE), -1, np.int32)
    sims = x @ x.T
    near = min(NEAREST + 1, n)
    pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    pool = np.concatenate((pool, np.random.default_rng(seed).integers(0, n, (n, RANDOM))), axis=1)
    own = np.take_along_axis(sims, pool, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    out = prune(sims, pool, own)
    reached = np.zeros(n, bool)
    front = np.array([medoid(x)])
    while True:
        while len(front):
            reached[front] = True
            nxt = np.unique(out[front])
            front = nxt[(nxt >= 0) & ~reached[np.maximum(nxt, 0)]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return out
        known = np.flatnonzero(reached)
        best = np.unravel_index(sims[np.ix_(lost, known)].argmax(), (len(lost), len(known)))
        node, via = lost[best[0]], known[best[1]]
        free = np.flatnonzero(out[via] < 0)
        if not len(free):
            out = np.concatenate((out, np.full((n, 1), -1, np.int32)), axis=1)
            free = [out.shape[1] - 1]
        out[via, free[0]] = node
        front = np.array([node])


def medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(0)).argmax())


def cosines(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS):
        out[i : i + PAIRS] = np.einsum("ij,ij->i", q[rows[i : i + PAIRS]], x[cols[i : i + PAIRS]])
    return out


def search(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, resident, cosine) of the visited pairs of at least WIDEN: a beam search from start, then widening within range."""
    n_q, n = len(q), len(x)
    seen = np.zeros((n_q, n), bool)
    seen[:, start] = True
    first = q @ x[start]
    held, value = np.full((n_q, beam), -1, np.int64), np.full((n_q, beam), -np.inf)
    held[:, 0], value[:, 0] = start, first
    done = np.zeros((n_q, beam), bool)
    near = np.flatnonzero(first >= WIDEN)
    found = [(near, np.full(len(near), start), first[near])]

    def visit(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The cosines of pairs not seen before, which are then seen."""
        seen[rows, new] = True
        cos = cosines(q, x, rows, new)
        wide = cos >= WIDEN
        found.append((rows[wide], new[wide], cos[wide]))
        return cos

    active = np.arange(n_q)
    while len(active):
        open_value = np.where(done[active] | (held[active] < 0), -np.inf, value[active])
        at = open_value.argmax(1)
        go = open_value[np.arange(len(active)), at] > -np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        new = links[held[active, at]]
        fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
        rows = np.broadcast_to(active[:, None], new.shape)
        gain = np.full(new.shape, -np.inf)
        gain[fresh] = visit(rows[fresh], new[fresh])
        ids = np.concatenate((held[active], np.where(fresh, new, -1)), axis=1)
        vals = np.concatenate((value[active], gain), axis=1)
        old = np.concatenate((done[active], np.zeros(new.shape, bool)), axis=1)
        top = np.argpartition(-vals, beam - 1, axis=1)[:, :beam]
        held[active], value[active], done[active] = (np.take_along_axis(v, top, 1) for v in (ids, vals, old))
    at = 0
    while at < len(found):  # what widening finds is appended, and widens in its turn
        rows, cols, _ = found[at]
        at += 1
        for i in range(0, len(rows), PAIRS // 8):
            new = links[cols[i : i + PAIRS // 8]]
            r = np.broadcast_to(rows[i : i + PAIRS // 8, None], new.shape)[new >= 0]
            new = new[new >= 0]
            fresh = ~seen[r, new]
            pair = np.unique(r[fresh].astype(np.int64) * n + new[fresh])
            if len(pair):
                visit(pair // n, pair % n)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", ignore_index=True)
    nodes = pdf["node"].to_numpy()
    links = graph(matrix(pdf["v"]), int(pdf["shard"].iloc[0]) * 1009 + int(pdf["r"].iloc[0]))
    return pd.DataFrame({"node": nodes, "links": [nodes[r[r >= 0]].tolist() for r in links]})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: (node, least node that it reaches), without the roots."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[ia], root[ib])
        new = root.copy()
        np.minimum.at(new, root[ia], low)
        np.minimum.at(new, root[ib], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    move = root != np.arange(len(ids))
    return ids[move], ids[root[move]]


def edges(block: pd.DataFrame) -> np.ndarray:
    """The united lists of a block's nodes, sorted by node, as places in the block: edges of all shards that end in it."""
    ids, lists = block["node"].to_numpy(), block["links"].tolist()
    links = np.full((len(ids), max(1, max(len(v) for v in lists))), -1, np.int64)
    for i, v in enumerate(lists):
        links[i, : len(v)] = v
    at = np.searchsorted(ids, links).clip(0, len(ids) - 1)
    return np.where((links >= 0) & (ids[at] == links), at, -1)


def _search(pdf: pd.DataFrame, beam: int) -> pd.DataFrame:
    """Links of two blocks r <= q of a shard, from rows (shard, r, q, own, node, mult, v, shards, links); own: the row's block.

    Residents are block r; queries block q, the residents themselves if it is the same.
    """
    pdf = pdf.sort_values("node", ignore_index=True)
    shard, r, q = (int(pdf[c].iloc[0]) for c in ("shard", "r", "q"))
    residents, queries = pdf[pdf["own"] == r], pdf[pdf["own"] == q]
    if not len(residents) or not len(queries):
        return pd.DataFrame({"node": [], "n_links": [], "root": []})
    ids, asked = residents["node"].to_numpy(), queries["node"].to_numpy()
    x = matrix(residents["v"])
    of = x if r == q else matrix(queries["v"])
    links, start = edges(residents), medoid(x)
    found = [search(of, x, links, start, min(beam, len(ids)))]
    if r != q:  # and the other way round: either may find a pair
        rows, cols, cos = search(x, of, edges(queries), medoid(of), min(beam, len(asked)))
        found.append((cols, rows, cos))
    if r == q:
        own = np.zeros(len(ids), bool)
        while True:
            rows, cols, _ = found[-1]
            own[rows[rows == cols]] = True
            missed = np.flatnonzero(~own)
            if not len(missed) or beam >= len(ids):
                break
            beam = min(4 * beam, len(ids))
            rows, cols, cos = search(of[missed], x, links, start, beam)
            found.append((missed[rows], cols, cos))
    a, b, cos = (np.concatenate(v) for v in zip(*found, strict=True))
    use = (cos >= THRESHOLD) & (asked[a] != ids[b])
    a, b = a[use], b[use]
    low, high = (np.minimum(a, b), np.maximum(a, b)) if r == q else (a, b)
    pair = np.unique(low * len(ids) + high)  # a pair that either search found is one link
    a, b = pair // len(ids), pair % len(ids)
    mine, theirs = np.array(queries["shards"].tolist())[a], np.array(residents["shards"].tolist())[b]
    if len(a):
        meets = (mine[:, :, None] == theirs[:, None, :]).any(2)
        first = np.where(meets, mine, np.iinfo(np.int64).max).min(1) == shard  # of the shards that both share, the least counts
    else:
        first = np.zeros(0, bool)
    ends = np.concatenate((asked[a[first]], ids[b[first]]))
    mult = np.concatenate((residents["mult"].to_numpy()[b[first]], queries["mult"].to_numpy()[a[first]]))
    some, at = np.unique(ends, return_inverse=True)
    count = np.bincount(at, mult, len(some)).astype(np.int64)
    nodes, roots = _forest(asked[a], ids[b]) if len(a) else (ids[:0], ids[:0])
    return pd.DataFrame({"node": np.concatenate((some, nodes)), "n_links": np.concatenate((count, np.zeros(len(nodes), np.int64))), "root": np.concatenate((some, roots))})


def found_links(nodes: DataFrame, centres: np.ndarray, overlap: int, beam: int = BEAM) -> DataFrame:
    """(node, n_links, root): counts, and links as a forest, from all shards."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # at most CENTRES

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = matrix(part.column(2).to_pylist()) @ c.T
                shards = np.argsort(-near, axis=1, kind="stable")[:, :overlap].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shards.size + 1, shards.shape[1], dtype=np.int32)), pa.array(shards.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["node", "mult", "v", "shards"])

    routed = common.stored(nodes.mapInArrow(route, "node long, mult long, v binary, shards array<long>"), "routed")
    sizes = routed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("m"))
    sizes = F.broadcast(common.stored(sizes, "sizes"))  # a row per centre, at most CENTRES
    placed = routed.withColumn("shard", F.explode("shards")).join(sizes, "shard")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    lists = placed.select("shard", F.col("own").alias("r"), "node", "v").groupBy("shard", "r").applyInPandas(_build, "node long, links array<long>")
    united = common.stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "graph")
    # each pair of blocks once; alone in its shard, a block is sent once
    rows = placed.join(united, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("shard", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("q"), "own", "node", "mult", "v", "shards", "links")
    return rows.groupBy("shard", "r", "q").applyInPandas(lambda pdf: _search(pdf, beam), "node long, n_links long, root long")


def audit(nodes: DataFrame, found: DataFrame, most: int = AUDIT) -> float:
    """The share of the links of a sample of nodes (by hash) that found has; the truth comes from all nodes.

    The sample doubles, up to MOST_AUDIT, while it has fewer than SOME_LINKS links.
    """
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(MOST_AUDIT).select("node", "v").toPandas()
    got = found.groupBy("node").agg(F.sum("n_links").alias("got"))
    while True:
        part = sample[:most]
        if not len(part):
            return 1.0
        shared = spark.sparkContext.broadcast((part["node"].to_numpy(), matrix(part["v"])))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    rows = batch.slice(at, 4096)
                    near = (matrix(rows.column(2).to_pylist()) @ x.T >= THRESHOLD) & (rows.column(0).to_numpy()[:, None] != ids)
                    n += (near * rows.column(1).to_numpy()[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["node", "n"])

        true = nodes.select("node", "mult", "v").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
        row = true.join(got, "node", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("got", F.lit(0)))).alias("got")).first()
        if row["n"] >= SOME_LINKS or most >= min(MOST_AUDIT, len(sample)):
            return row["got"] / row["n"] if row["n"] else 1.0
        most *= 2


def links_of(copies: DataFrame) -> DataFrame:
    """(node, n_links, root) of the vectors (v, node, mult), all of one dimension."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in x], pa.binary())], ["node", "mult", "v"])

    nodes = common.stored(copies.select("node", "mult", "v").mapInArrow(unit, "node long, mult long, v binary"), "nodes")
    k = max(1, min(CENTRES, math.ceil(OVERLAP * nodes.count() / SHARD * 1.5)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, PER_CENTRE * k)).select("v").toPandas()
    centres = centres_of(matrix(sample["v"]), k)
    overlap, beam = min(OVERLAP, len(centres)), BEAM
    while True:
        found = common.stored(found_links(nodes, centres, overlap, beam), "found")
        if audit(nodes, found) >= RECALL or (overlap == len(centres) and beam >= SHARD):
            return found
        if overlap < len(centres):
            overlap = min(2 * overlap, len(centres))
        else:
            beam *= 4


def near_vectors(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of table: id_col, n_links, component_id, kept.

    Vectors that are null or zero, or hold a null or a non-finite component, link with nothing; vectors of different
    dimensions don't link with each other, and every dimension that occurs is compared. Equal vectors link with each
    other and share all links. Ids should be unique: an id that stands for several vectors gets the links of all. A
    null id has no component and isn't kept. An empty table gives an empty result. Other columns are not read.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vec, lambda c: c != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.when(sound, vec).alias("v"))
    copies = rows.filter("v IS NOT NULL AND id IS NOT NULL").groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult"))
    copies = common.stored(copies.withColumn("d", F.size("v")), "copies")
    sizes = [r["d"] for r in copies.groupBy("d").count().filter("count > 1").orderBy("d").collect()]  # a row per dimension
    found = [links_of(copies.filter(F.col("d") == d)) for d in sizes]
    none = copies.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("root")).limit(0)
    found = common.stored(functools.reduce(DataFrame.unionByName, found, none), "found")
    tops = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    of_node = copies.join(counts, "node", "left").join(tops, copies["node"] == tops["id"], "left")
    of_node = of_node.select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(of_node, "v", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
