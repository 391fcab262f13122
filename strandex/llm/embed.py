"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of one label are rotated by a fixed random rotation and split into blocks of a few dimensions. Cosine c or
more is squared distance 2 - 2c or less; it is the sum over blocks, so that some block holds at most its share of it, in
proportion to its dimensions. Each block is therefore joined on its own under that budget (a range join over cells of
its first dimensions, with the block's distance checked in the join), and the union of candidates is verified with the
whole vectors in double precision. A pair belongs to the first block in which it is that near, and is taken there only.
Equal vectors are one point with a count.

A large group of near copies is a dense cell in every block. Its pairs are never rows: a full cell of alike vectors is cut into
chunks, two chunks meet in one product of matrices, and what leaves a product is one row for each vector, with the number of its links and
an edge to the smallest vector that it reaches there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .base import components, forget, written

WIDTH = 8  # dimensions of a block
GRID = 3  # dimensions of a block that its cells divide
DENSE = 512  # vectors in a cell beyond which its pairs may be counted by products of matrices
ALIKE = 32  # and are, if a vector has so many more near it on average
CHUNK = 512  # vectors in a chunk: a product holds CHUNK * CHUNK numbers
SLACK = 1e-9  # added to squared distances, for rounding in the rotation


def rotation(dim: int) -> np.ndarray:
    """The same orthogonal matrix for a dimension, whoever asks."""
    q, r = np.linalg.qr(np.random.default_rng(7919 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rotated(batches):
    """mapInPandas: (id, rot), the unit vectors of points after the rotation. Written once, so that all who compare use the same numbers."""
    turns: dict[int, np.ndarray] = {}
    for pdf in batches:
        vecs = list(pdf["vec"])
        rot: list = [None] * len(vecs)
        for dim in sorted({len(v) for v in vecs}):
            at = [i for i, v in enumerate(vecs) if len(v) == dim]
            x = np.stack([np.asarray(vecs[i], np.float64) for i in at])
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i, v in zip(at, x @ turns.setdefault(dim, rotation(dim)), strict=True):
                rot[i] = v
        yield pdf.assign(rot=rot)


def _budget(cosine: float, width: int, dim: int) -> float:
    return (2 - 2 * cosine + SLACK) * width / dim


def _blocks(cosine: float):
    """mapInPandas: a row for each block of each point, with its cell, and the cells after it that its ball touches."""

    def rows(batches):
        for pdf in batches:
            ids, labels, vecs = pdf["id"].to_numpy(), pdf["label"].to_numpy(), list(pdf["rot"])
            for dim in sorted({len(v) for v in vecs}):
                at = np.array([i for i, v in enumerate(vecs) if len(v) == dim])
                x = np.stack([vecs[i] for i in at])
                for b, lo in enumerate(range(0, dim, WIDTH)):
                    part = np.zeros((len(at), WIDTH))
                    width = min(WIDTH, dim - lo)
                    part[:, :width] = x[:, lo : lo + width]
                    yield from _cells(ids[at], labels[at], dim, b, part, min(GRID, width), _budget(cosine, width, dim))

    return rows


def _near(x: np.ndarray, y: np.ndarray, b: int, cosine: float) -> np.ndarray:
    """Which rows of x and y are within the budget of block b; the sum is in the order of the join's, to the last bit.

    x and y hold rotated vectors, and are broadcast against each other.
    """
    dim = x.shape[-1]
    width = min(WIDTH, dim - b * WIDTH)
    total = 0.0
    for k in range(width):
        d = x[..., b * WIDTH + k] - y[..., b * WIDTH + k]
        total = total + d * d
    return total <= _budget(cosine, width, dim)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y, one by one, summed in order of the components."""
    dot = xx = yy = 0.0
    for k in range(x.shape[1]):
        dot, xx, yy = dot + x[:, k] * y[:, k], xx + x[:, k] * x[:, k], yy + y[:, k] * y[:, k]
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def _product(cosine: float):
    """applyInPandas: links between two chunks of a cell, or within one, as (id, others, root)."""

    def run(pdf):
        b, i, j = int(pdf["block"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("id", kind="stable")
        left = pdf[pdf["chunk"] == i]
        right = left if i == j else pdf[pdf["chunk"] == j]
        x, y = (np.stack(list(s["rot"])) if len(s) else np.zeros((0, 1)) for s in (left, right))
        if not len(x) or not len(y):
            return pd.DataFrame({"id": np.empty(0, np.int64), "others": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        hx, hy = left["home"].to_numpy(bool), right["home"].to_numpy(bool)
        ids, to = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        link = x @ y.T >= cosine - 1e-6  # rotated vectors have length 1; the rest looks at these pairs only
        link &= (hx[:, None] | hy[None, :]) & (ids[:, None] != to[None, :])
        p, q = np.nonzero(link)
        first = _near(x[p], y[q], b, cosine)
        for e in range(b):
            first &= ~_near(x[p], y[q], e, cosine)
        p, q = p[first], q[first]
        vx, vy = (np.stack([np.asarray(v, np.float64) for v in s["vec"]]) for s in (left, right))
        good = _cosines(vx[p], vy[q]) >= cosine
        p, q = p[good], q[good]
        others = np.zeros(len(ids), np.int64)
        np.add.at(others, p, right["n"].to_numpy(np.int64)[q])
        back = np.zeros(len(to), np.int64)
        if i != j:
            np.add.at(back, q, left["n"].to_numpy(np.int64)[p])
        # The smallest id that each reaches inside the product.
        root, far = ids.copy(), to.copy()
        while True:
            old = root.copy(), far.copy()
            np.minimum.at(root, p, far[q])
            if i == j:
                far = root.copy()
            else:
                np.minimum.at(far, q, root[p])
            if (old[0] == root).all() and (old[1] == far).all():
                break
        out = pd.DataFrame({"id": ids, "others": others, "root": root})
        if i != j:
            out = pd.concat([out, pd.DataFrame({"id": to, "others": back, "root": far})])
        return out[out["others"] > 0]

    return run


def _verify(cosine: float):
    """mapInPandas: of candidates (a, b, block) with both points those that link and belong to the block."""

    def run(batches):
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            blocks, dims = pdf["block"].to_numpy(), pdf["x"].map(len).to_numpy()
            for dim in np.unique(dims):
                for b in np.unique(blocks[dims == dim]):
                    at = np.flatnonzero((dims == dim) & (blocks == b))
                    rx, ry, vx, vy = (np.stack([np.asarray(v, np.float64) for v in pdf[c].iloc[at]]) for c in ("rx", "ry", "x", "y"))
                    good = _cosines(vx, vy) >= cosine
                    for e in range(b):
                        good &= ~_near(rx, ry, e, cosine)
                    keep[at] = good
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _cells(ids, labels, dim, b, part, grid, budget):
    r = float(np.sqrt(budget))
    side = 2 * r
    low = np.floor((part[:, :grid] - r) / side).astype(np.int64)
    high = np.floor((part[:, :grid] + r) / side).astype(np.int64)
    own = np.floor(part[:, :grid] / side).astype(np.int64)
    code = lambda c: sum((c[:, g] + 4096) << (14 * g) for g in range(grid))  # noqa: E731  |c| is at most 1 / side
    mine = code(own)
    frames = [(np.arange(len(ids)), mine, np.ones(len(ids), bool))]
    for corner in range(1 << grid):
        cell = np.stack([np.where(corner >> g & 1, high[:, g], low[:, g]) for g in range(grid)], axis=1)
        valid = np.ones(len(ids), bool)
        for g in range(grid):  # a ball inside one slice has the corner once
            valid &= (not corner >> g & 1) | (high[:, g] != low[:, g])
        c = code(cell)
        keep = np.flatnonzero(valid & (c > mine))
        if len(keep):
            frames.append((keep, c[keep], np.zeros(len(keep), bool)))
    for at, c, home in frames:
        out = {"label": labels[at], "dim": np.full(len(at), dim, np.int32), "block": np.full(len(at), b, np.int32), "cell": c, "home": home, "id": ids[at], "budget": np.full(len(at), budget)}
        yield pd.DataFrame(out | {f"c{k}": part[at, k] for k in range(WIDTH)})


def neighbours(vectors: DataFrame, cosine: float = 0.98) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, degree, edges): a point (id, label, vec, n) for each distinct vector and label; (id, others), to be summed, the vectors
    of other points that link with it; (a, b), edges of which the components are those of the links.

    `vectors` has id, label and vec (an array of doubles), all usable.
    """
    kind = dict(vectors.dtypes)["label"]
    points = vectors.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "label", "vec", "n")
    points = written(points.mapInPandas(_rotated, f"id long, label {kind}, vec array<double>, n long, rot array<double>"), "points")
    coords = ", ".join(f"c{k} double" for k in range(WIDTH))
    rows = points.select("id", "label", "rot").mapInPandas(_blocks(cosine), f"label {kind}, dim int, block int, cell long, home boolean, id long, budget double, {coords}")
    rows = written(rows, "blocks")
    key = ["label", "dim", "block", "cell"]
    # Both ways give the same links. A full cell of unlike vectors has few pairs, so that the join is the cheaper one there; how alike
    # they are is told by the rows that share a slice in every dimension of the block.
    slices = F.xxhash64(*(F.floor(F.col(f"c{k}") / (2 * F.sqrt("budget"))) for k in range(WIDTH)))
    fine = rows.groupBy(*key, slices.alias("slice")).agg(F.count("*").alias("m"), F.max("home").alias("h"))
    full = fine.groupBy(*key).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s"), F.max("h").alias("h"))
    full = full.where((F.col("m") > DENSE) & F.col("h") & (F.col("s") > F.col("m") * (ALIKE + 1)))
    full = written(full.select(*key, F.ceil(F.col("m") / CHUNK).cast("int").alias("parts")), "dense")
    thin = rows.join(full, key, "left_anti")

    home = thin.where("home").drop("home", "budget")
    x, y = thin.alias("x"), home.alias("y")
    near = " + ".join(f"(x.c{k} - y.c{k}) * (x.c{k} - y.c{k})" for k in range(WIDTH))
    same = " AND ".join(f"x.{k} = y.{k}" for k in key)
    # A home row meets the home rows after it; a visiting row meets all that live in the cell.
    pairs = x.join(y, F.expr(f"{same} AND (NOT x.home OR x.id < y.id) AND x.id <> y.id AND {near} <= x.budget"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.col("x.label").alias("label"), F.col("x.block").alias("block"))
    side = lambda id, v, r, n: points.select(F.col("id").alias(id), "label", F.col("vec").alias(v), F.col("rot").alias(r), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "rx", "nx"), ["a", "label"]).join(side("b", "y", "ry", "ny"), ["b", "label"])
    links = written(both.select("a", "b", "block", "x", "y", "rx", "ry").mapInPandas(_verify(cosine), "a long, b long"), "links")
    count = points.select("id", "n")
    degree = links.join(count.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("n").alias("others"))
    degree = degree.unionByName(links.join(count.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), F.col("n").alias("others")))

    # Dense cells: every vector goes to the products of its chunk with each chunk.
    own = rows.join(full, key).select(*key, "id", "home", "parts").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o"))
    sent = sent.join(points.select("id", "label", "vec", "rot", "n"), ["id", "label"]).select(*key, "i", "j", "chunk", "id", "home", "n", "vec", "rot")
    dense = written(sent.groupBy(*key, "i", "j").applyInPandas(_product(cosine), "id long, others long, root long"), "products")
    degree = degree.unionByName(dense.select("id", "others"))
    edges = links.unionByName(dense.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    forget(rows, full)
    return points, degree, edges


def near_dedup(df: DataFrame, cosine: float = 0.98, id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `df`.

    Only vectors with equal, non-null labels, equal lengths and finite, non-zero values are compared; the others have no
    links and are their own component. Equal vectors link with each other. A cosine of just `cosine` links, by sums of doubles in the
    order of the components. `kept` marks the smallest id of a component. Ids are taken to be distinct: a repeated row counts
    as one more vector, and different vectors under one id share their links. Other columns of `df`, whatever their names,
    are ignored. A null id stays, without links; an empty table gives an empty one.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.transform(F.col(vec), lambda v: v.cast("double")).alias("vec"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    points, degree, edges = neighbours(good, cosine)
    weight = degree.groupBy("id").agg(F.sum("others").alias("others"))
    comp = components(edges)
    # Points by vector; a vector is found again by its label and itself.
    of = points.join(weight, "id", "left").join(comp, "id", "left").select("label", "vec", F.col("id").alias("point"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumn("ok", usable).join(of.withColumn("ok", F.lit(True)), ["ok", "label", "vec"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("id") == comp_id).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near copies among all `embeddings`, by label, with their numbers of links. Awkward rows: see near_dedup."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT r.vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(c)::BIGINT AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""
