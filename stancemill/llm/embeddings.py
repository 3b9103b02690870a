"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Every vector is quantised once. Tiles get the codes (a byte a component), the scale and the error bound;
pairs of a tile that surely reach the threshold or surely don't are settled there, and only for the vectors of
the pairs between are the full components fetched and multiplied in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import dropped, small_batches, staged
from stancemill.llm.components import components

#: Vectors of a block; a tile holds two blocks.
BLOCK = 2048
#: What rounding may add to a cosine in double precision, for vectors of any length.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors, and upper bounds of the decoding errors' norms."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1) * (1 + 1e-12), np.linalg.norm(unit - decoded, axis=1) * (1 + 1e-9) + 1e-12


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two at their largest component, so that no square leaves a double's range; cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x and that of y, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def bounds(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(products of the decoded vectors, how far the cosines can lie from them) of all pairs of two quantised() blocks.

    |u.v - u'.v'| <= |v'| e_u + |u'| e_v + e_u e_v holds for decoded u', v' with errors e_u, e_v.
    """
    (qx, sx, dx, ex), (qy, sy, dy, ey) = x, y
    # Sums of products of int8 codes are whole numbers that the chosen float type holds exactly.
    exact = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    middle = (qx.astype(exact) @ qy.astype(exact).T).astype(np.float64)
    middle *= sx[:, None]
    middle *= sy[None, :]
    return middle, np.outer(ex, dy + ey) + np.outer(dx, ey) + SLACK


def tile_pairs(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of the pairs of rows of two quantised() blocks whose cosine may reach the threshold; sure: it does, whatever the errors."""
    middle, error = bounds(x, y)
    i, j = np.nonzero(middle + error >= threshold)
    return i, j, middle[i, j] - error[i, j] >= threshold


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gid, codes, scale, norm and error of vectors of any lengths."""
    for batch in batches:
        lists = batch.column("embedding")
        width = lists.value_lengths().to_numpy()
        codes, rest = [None] * len(width), np.empty((3, len(width)))
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, width))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            x = scaled(flat[at[rows][:, None] + np.arange(w)])
            q, scale, norm, error = quantised(x / np.linalg.norm(x, axis=1)[:, None])
            rest[:, rows] = scale, norm, error
            for k, c in zip(rows.tolist(), q):
                codes[k] = c.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(codes, pa.binary()), *map(pa.array, rest)], names=["gid", "codes", "scale", "norm", "error"])


def _sides(key: tuple, table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, bool]:
    """A tile's rows by gid, and the numbers of those of its two blocks; whether they are one."""
    one, other = key[-2].as_py(), key[-1].as_py()
    table = table.sort_by("gid").combine_chunks()
    block = table["block"].to_numpy()
    return table, np.flatnonzero(block == one), np.flatnonzero(block == other), one == other


def _candidates(table: pa.Table, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of a tile: each pair once."""
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(table.num_rows, -1)
    scale, norm, error = (table[c].to_numpy() for c in ("scale", "norm", "error"))
    i, j, sure = tile_pairs(*((codes[s], scale[s], norm[s], error[s]) for s in (left, right)), threshold)
    i, j = left[i], right[j]
    once = i < j if same else i != j
    return i[once], j[once], sure[once]


def _doubtful(threshold: float):
    """gids of the vectors of a tile that are in a pair which the codes do not settle."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table, left, right, same = _sides(key, table)
        i, j, sure = _candidates(table, left, right, same, threshold)
        return pa.table({"gid": table["gid"].take(pa.array(np.unique(np.concatenate((i[~sure], j[~sure])))))})

    return work


def _tile(threshold: float):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        table, left, right, same = _sides(key, table)
        i, j, sure = _candidates(table, left, right, same, threshold)
        full = table["embedding"].combine_chunks()
        held = np.flatnonzero(full.is_valid().to_numpy(zero_copy_only=False))
        place = np.zeros(table.num_rows, np.int64)
        place[held] = np.arange(len(held))
        open_ = np.flatnonzero(~sure)
        if len(open_):
            x = scaled(full.filter(full.is_valid()).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1))
            for k in range(0, len(open_), 1 << 16):
                some = open_[k : k + (1 << 16)]
                sure[some] = cosines(x[place[i[some]]], x[place[j[some]]]) >= threshold
        i, j = i[sure], j[sure]
        gid, copies = table["gid"].to_numpy(), table["copies"].to_numpy()
        links = np.zeros(len(gid), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root, linked = local_roots(len(gid), i, j), np.flatnonzero(links)
        return pa.table({"gid": gid[linked], "links": links[linked], "root": gid[root[linked]]})

    return work


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector of vectors (vec_id, embedding, label, ...).

    Vectors link when their labels are equal and not null, their lengths agree, and their cosine in double
    precision is threshold at least, whatever their components' size. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: they have no links and are their own component. Equal vectors with equal labels are
    compared once and counted with their number. Rows with the same vec_id are vectors of their own. A vector
    without id counts as a link but never names a component; alone, its component_id is null and it is kept.
    No input rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.withColumn("fits", F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    hashes = {"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "label", "embedding")}
    fit = v.filter("fits").withColumns(hashes)
    # min(), not first(): it keeps the aggregation partial; equal hashes mean equal vectors.
    groups = fit.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("label").alias("label"), F.min("embedding").alias("embedding"))
    groups = staged(groups.withColumns({"gid": F.monotonically_increasing_id(), "width": F.size("embedding")}), "vectors")
    codes = staged(groups.select("gid", "embedding").mapInArrow(_coded, "gid long, codes binary, scale double, norm double, error double"), "codes")
    # Written, so that the join's own exchange can split a label that many vectors have.
    sizes = staged(groups.groupBy("label", "width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = groups.select("label", "width", "gid", "copies").join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.hash("gid"), F.col("blocks")).cast("int"))
    tile = ["label", "width", "one", "two"]

    def tiles(vectors: DataFrame) -> DataFrame:
        # A label of n vectors takes n * n / BLOCK copies of codes: the price of comparing all of them.
        mine = dealt.join(vectors, "gid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return mine.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("blocks", "other").groupBy(*tile)

    open_ = staged(tiles(codes).applyInArrow(_doubtful(threshold), "gid long").distinct(), "doubtful")
    full = codes.join(groups.select("gid", "embedding").join(open_, "gid"), "gid", "left")
    found = staged(tiles(full).applyInArrow(_tile(threshold), "gid long, links long, root long"), "tiles")
    dropped(codes, open_, sizes)
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("gid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "gid")
    placed = groups.select("gid", "h1", "h2", "copies", "least").join(links, "gid", "left").join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = staged(placed.join(names, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "placed")
    keyed = v.select("vec_id", *(F.when(F.col("fits"), h).alias(k) for k, h in hashes.items()))
    out = keyed.join(placed, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
