"""MinHash near-deduplication with an LSH forest.

Documents with equal shingle sets are one node. A node's signature holds COLUMNS minhashes. Each tree of the forest
sorts all nodes by another order of those columns (a range sort over tree, label and node, so equal labels don't meet
in one task). In a sorted order nodes with a common prefix stand together; a region is a run that agrees in its first
BASE columns. Small regions are taken whole; in a large one the depth adapts: every node is a candidate with those
neighbours with which it shares the longest prefixes, which the sort puts beside it. That joins most of a large
region cheaply, but not all of it: copies that link to one text and not to each other needn't stand beside it. So
every large region that still holds more than one component is then compared whole, block against block, on full
sets. At a similarity of 0.75 a pair shares BASE columns in a tree with probability 0.316, and in none of TREES with
5e-6.

A task sees regions only as far as its range reaches; a region that a range boundary cuts is cut elsewhere in the
other trees.

Candidates whose sketches rule out a link (five standard deviations) go; the others are confirmed on full sets: first
each node with its best candidate, then what those links leave in different components, then the large regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.components import components
from tokensieve.llm.exact_dedup import BLOOM
from tokensieve.llm.shingles import mix, shingle_sets

WORDS, PERCENT = 5, 75
COLUMNS, TREES, BASE, DEPTH = 128, 32, 4, 12
#: Regions up to this size are taken whole; in larger ones a node meets this many neighbours of the sorted order.
WHOLE, NEIGHBOURS = 8, 3
#: Nodes of a block of a large region; a task holds two blocks.
BLOCK = 512
#: Columns of a sketch agree in their two bits with probability s + (1 - s) / 4.
LEAST_SKETCH = 0.52

_A = mix(np.arange(1, COLUMNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1, COLUMNS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
SEEN = "id long, n_shingles long, node binary, signature binary"


def signature(s: np.ndarray) -> np.ndarray:
    """COLUMNS minhashes of a set, 16 bits each."""
    least = np.full(COLUMNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * _A + _B).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype(">u2")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, found = [], [], []
        for s in shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], WORDS):
            sizes.append(len(s))
            if len(s):
                with np.errstate(over="ignore"):
                    place = np.arange(1, len(s) + 1, dtype=np.uint64)
                    nodes.append(np.array([mix(s * place).sum() + np.uint64(len(s)), mix(s ^ place).sum()], "<u8").tobytes())
                found.append(signature(s).tobytes())
            else:
                nodes.append(None)
                found.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["id", "n_shingles", "node", "signature"])


#: The columns of each tree's label, and the columns' two bits that a sketch keeps.
_ORDERS = (np.arange(TREES)[:, None] * BASE + np.arange(DEPTH)) % COLUMNS


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, label, node, n, sketch) for each node and tree."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(n, COLUMNS)
            sketch = np.packbits(((sig[:, :, None] >> np.array([15, 14], ">u2")) & 1).astype(np.uint8).reshape(n, -1), axis=1)
            labels = sig[:, _ORDERS].tobytes()
            width = DEPTH * 2
            row = np.repeat(np.arange(n), TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int8), n)),
                    pa.Array.from_buffers(pa.binary(width), n * TREES, [None, pa.py_buffer(labels)]).cast(pa.binary()),
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.Array.from_buffers(pa.binary(sketch.shape[1]), n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()).take(pa.array(row)),
                ],
                ["tree", "label", "node", "n", "sketch"],
            )


def pairs_in_region(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (i, j), i < j, in a sorted region with these labels (rows by columns)."""
    n = len(labels)
    if n <= WHOLE:
        return np.triu_indices(n, 1)
    # in the sorted order the longest common prefixes are those with the nearest; the first of each run that agrees
    # in all columns stands for the run's others
    i = np.concatenate([np.arange(n - d) for d in range(1, NEIGHBOURS + 1)])
    j = np.concatenate([np.arange(d, n) for d in range(1, NEIGHBOURS + 1)])
    head = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]).any(1))))
    first = head[np.searchsorted(head, np.arange(n), side="right") - 1]
    far = np.flatnonzero(np.arange(n) - first > NEIGHBOURS)
    return np.concatenate((i, first[far])), np.concatenate((j, far))


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, est) from a sorted range of (tree, label, node, n, sketch)."""
    width = DEPTH * 2
    out: list[list] = [[], [], []]

    def region(rows: list[tuple]) -> None:
        labels = np.frombuffer(b"".join(r[1] for r in rows), ">u2").reshape(-1, DEPTH)
        i, j = pairs_in_region(labels)
        n = np.array([r[3] for r in rows])
        use = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        i, j = i[use], j[use]
        sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        apart = sketch[i] ^ sketch[j]
        differs = _ONES[(apart | apart >> 1) & 0x55].sum(1)
        est = (4 * (1 - differs / COLUMNS) - 1) / 3
        for a, b, e in zip(i[est >= LEAST_SKETCH].tolist(), j[est >= LEAST_SKETCH].tolist(), est[est >= LEAST_SKETCH].tolist(), strict=True):
            out[0].append(rows[b][2])
            out[1].append(rows[a][2])
            out[2].append(e)

    def packed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["x", "y", "est"])
        for column in out:
            column.clear()
        return batch

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        rows = list(zip(*columns, strict=True))
        if not rows:
            continue
        flat = np.frombuffer(b"".join(columns[1]), np.uint8).reshape(-1, width)[:, : BASE * 2]
        tree = np.array(columns[0])
        cut = [0, *(np.flatnonzero((flat[1:] != flat[:-1]).any(1) | (tree[1:] != tree[:-1])) + 1).tolist(), len(rows)]
        for a, b in zip(cut, cut[1:], strict=False):
            new = rows[a:b]
            if a == 0 and held and held[-1][0] == new[0][0] and held[-1][1][: BASE * 2] == new[0][1][: BASE * 2]:
                held += new
            else:
                if len(held) > 1:
                    region(held)
                held = new
        if len(out[0]) > 20_000:
            yield packed()
    if len(held) > 1:
        region(held)
    yield packed()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()], WORDS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "items"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), "<u8") for v in (a, b))
            same = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * same >= PERCENT * (len(a) + len(b) - same))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) that link, by their full sets."""
    left = pairs.select("x", "y").join(sets.select(F.col("node").alias("x"), F.col("items").alias("ix")), "x")
    both = left.join(sets.select(F.col("node").alias("y"), F.col("items").alias("iy")), "y").select("x", "y", "ix", "iy")
    return both.mapInArrow(_confirmed, "x long, y long")


def links_between(left: list[np.ndarray], right: list[np.ndarray], of_left: np.ndarray, of_right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (place in left, place in right) between sets of different components.

    of_left and of_right number the components; a pair that earlier links connect isn't compared.
    """
    of_left, of_right = of_left.copy(), of_right.copy()
    sizes = np.array([len(s) for s in right])
    out: list[tuple[int, int]] = []
    for at in np.split(np.arange(len(right)), np.flatnonzero(np.diff(np.cumsum(sizes) // 2_000_000)) + 1):
        items = np.concatenate([right[j] for j in at])
        order = items.argsort(kind="stable")
        items, owner = items[order], np.repeat(np.arange(len(at)), sizes[at])[order]
        for i, s in enumerate(left):
            n = sizes[at]
            use = (of_right[at] != of_left[i]) & (100 * np.minimum(n, len(s)) >= PERCENT * np.maximum(n, len(s)))
            if not use.any():
                continue
            low, high = items.searchsorted(s, "left"), items.searchsorted(s, "right")
            many = high - low
            found = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            same = np.bincount(owner[found], minlength=len(at))
            for j in at[use & (100 * same >= PERCENT * (n + len(s) - same))].tolist():
                if of_right[j] != of_left[i]:
                    out.append((i, j))
                    gone = of_right[j]
                    of_right[of_right == gone] = of_left[i]
                    of_left[of_left == gone] = of_left[i]
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """(x, y) from the rows (i, j, block, node, component, items) of two blocks, or of one if i = j."""
    block, nodes = table.column("block").to_numpy(), table.column("node").to_numpy()
    sets = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("items")]
    of = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    a, b = (np.flatnonzero(block == table.column(k)[0].as_py()) for k in ("i", "j"))
    links = links_between([sets[k] for k in a], [sets[k] for k in b], of[a], of[b]) if len(a) and len(b) else []
    return pa.table({"x": pa.array([nodes[a[i]] for i, _ in links], pa.int64()), "y": pa.array([nodes[b[j]] for _, j in links], pa.int64())})


def large_region_links(nodes: DataFrame, tops: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (x, y) that connect the components (tops) in every region of more than WHOLE nodes.

    Regions that are one component already, or have the same nodes as another, needn't be read again. A region's nodes
    are dealt to blocks by hash, and each pair of blocks is a group of its own, so no task holds a region; pairs never
    become rows, only a spanning forest of each group does.
    """
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("signature"), t * (BASE * 2) + 1, F.lit(BASE * 2)))
    known = nodes.join(tops.select(F.col("id").alias("node"), "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "signature")
    members = known.select("node", "component", F.posexplode(labels).alias("tree", "base"))
    found = members.groupBy("tree", "base").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("print"), F.min("component").alias("low"), F.max("component").alias("high"))
    regions = found.filter((F.col("size") > WHOLE) & (F.col("low") != F.col("high"))).dropDuplicates(["size", "print"])
    regions = regions.select("tree", "base", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    regions = common.stored(regions.coalesce(common.few(nodes.sparkSession)), "regions")
    members = common.stored(members.join(regions, ["tree", "base"]).coalesce(common.few(nodes.sparkSession, 2)), "members")
    sets = texts.join(members.select(F.col("node").alias("id")).distinct(), "id").select("id", "text").mapInArrow(_sets, "node long, items binary")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "base", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    return dealt.join(sets, "node").groupBy("tree", "base", "i", "j").applyInArrow(_block_links, "x long, y long")


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct shingles of five words, or the
    whole sequence of a shorter text. Texts without words, null ones included, have an empty set and link with
    nothing. Rows with one id count as one document. A row with a null id gets its set's size, no component and kept
    false. An empty table gives an empty result. Other columns of docs are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with common.settings(spark, common.BATCHES):
        seen, nodes, tops = _linked(spark, texts)
    of_node = nodes.join(tops, nodes["node"] == tops["id"], "left").select(F.col("set").alias("node"), F.coalesce("component", nodes["node"]).alias("component_id"))
    rows = seen.select("id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _linked(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures by row, nodes by set, and the component of each node that has links, all stored."""
    few = common.few(spark)
    seen = common.stored(texts.mapInArrow(_signatures, SEEN), "signatures")
    some = seen.filter("node IS NOT NULL AND id IS NOT NULL")
    # a node's id is the least doc id with its set
    nodes = some.groupBy(F.col("node").alias("set")).agg(F.min(F.struct("id", "n_shingles", "signature")).alias("r"))
    nodes = common.stored(nodes.select("set", F.col("r.id").alias("node"), F.col("r.n_shingles").alias("n"), F.col("r.signature").alias("signature")).coalesce(common.few(spark, 2)), "nodes")

    sorted_rows = nodes.select("node", "n", "signature").mapInArrow(_labels, "tree byte, label binary, node long, n long, sketch binary")
    forest = sorted_rows.repartitionByRange(max(common.partitions(spark), 2), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = forest.mapInArrow(_candidates, "x long, y long, est double").filter("x != y")
    found = found.groupBy("x", "y").agg(F.max("est").alias("est"))
    pairs = common.stored(found.coalesce(few), "candidates")

    ends = common.stored(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct().coalesce(few), "ends")
    with common.settings(spark, BLOOM):
        sets = common.stored(texts.join(ends.filter("id IS NOT NULL"), "id").select("id", "text").mapInArrow(_sets, "node long, items binary"), "sets")
    best = Window.partitionBy("x").orderBy(F.desc("est"), "y")
    firsts = pairs.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    # sets are read by many tasks and few pairs link, so links are dealt anew before they are written
    links = common.stored(confirmed(firsts, sets).repartition(few), "links")
    parts = components(links.toDF("a", "b"), few)
    rest = pairs.join(parts.select(F.col("id").alias("x"), F.col("component").alias("cx")), "x", "left")
    rest = rest.join(parts.select(F.col("id").alias("y"), F.col("component").alias("cy")), "y", "left")
    rest = rest.filter("coalesce(cx, x) != coalesce(cy, y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    more = common.stored(confirmed(rest, sets).repartition(few), "links")
    links = links.union(more)
    tops = common.stored(components(links.toDF("a", "b"), few).coalesce(few), "tops")
    with common.settings(spark, BLOOM):
        last = common.stored(large_region_links(nodes, tops, texts).repartition(few), "links")
    if not last.isEmpty():
        tops = common.stored(components(links.union(last).toDF("a", "b"), few).coalesce(few), "tops")
    return seen, nodes, tops


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, common.documents(spark, sf_dir))


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of which each group keeps one; the columns stay, whatever their names.

    Rows with a null id stay, for want of a group, and so do texts without words; of a repeated id all rows stay or go.
    An empty table gives an empty result.
    """
    plain, names = common.renamed(docs)
    dropped = near_dedup(spark, plain, names["doc_id"], names["text"]).withColumnRenamed(names["doc_id"], "_id").filter(~F.col("kept"))
    return common.restored(common.without(plain, dropped.select(F.col("_id").alias(names["doc_id"])), names["doc_id"]), names)
