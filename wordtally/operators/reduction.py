"""M3: whitened principal components of sparse feature rows.

A randomized range finder (Halko, Martinsson, Tropp 2011) works on the long
form ``(id, idx, value)``; nothing dense of size documents x features exists,
and the driver only ever holds square matrices of ``components + OVERSAMPLE``
columns.

* The rows are dealt into chunks of a bounded number of documents and entries.
  A chunk is one row of arrays (a cell); its entries name their features by
  their place among the features that the chunk holds.
* A matrix over the features is a table of tiles of ``TILE`` features. A tile
  sends to each chunk the rows of the features that the chunk holds and no
  others, so what is sent follows the entries, not chunks x features. The chunk
  takes them in order, multiplies, and sends back rows of the same features;
  nothing of size documents x components is sent, and nothing is broadcast.
* Centring is folded into the algebra: with column means ``mu`` and
  ``c = mu' Q``, ``Xc' Xc Q = X' X Q - n mu c'``.
* After ``POWER`` rounds of subspace iteration, each orthonormalized through
  the small Gram matrix, a Rayleigh-Ritz step gives the axes. Scaled by
  ``sqrt(n) / singular value`` they map the fitted rows to components of mean
  0, variance 1 and correlation 0.

Directions without variance get a zero axis. The axes belong to the
transformation: they are saved and loaded with it and applied to new rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.session import drop_checkpoints, reliable_checkpoint

OVERSAMPLE = 10
POWER = 3
#: Features of a tile.
TILE = 1024
#: Documents and entries of a chunk; few rows are cut into up to ``FEW_CHUNKS`` smaller ones. What is sent in a round
#: follows the pairs of a chunk and a feature that it holds, so chunks are large.
CHUNK_ROWS, CHUNK_ENTRIES = 32_768, 4_000_000
FEW_CHUNKS, FEW_ENTRIES = 16, 32_768
#: Features of a chunk whose rows a task holds at once.
BLOCK = 8192
#: Entries multiplied at once, and chunks that one row of a tile's needs names.
STRIP, LOT = 4096, 64
#: Share of the largest variance under which a direction counts as constant.
NO_VARIANCE = 1e-10
CELL = "chunk long, tile long, size int, feats binary, rows binary, cols binary, vals binary, data binary"
NEED = "tile long, lot int, chunk long, at binary"


@dataclass
class Reduction:
    """Fitted axes: ``axes(idx, mean, axis)`` maps feature rows to ``components`` whitened values."""

    axes: DataFrame
    components: int
    n_features: int


def sparse_rows(long: DataFrame) -> DataFrame:
    """``(id, idx, value)`` -> ``id, ix array<int>, vx array<double>`` sorted by idx."""
    g = long.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_e"))
    return g.select("id", F.col("_e.idx").cast("array<int>").alias("ix"), F.col("_e.value").alias("vx"))


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


@dataclass
class Cells:
    """Rows dealt into chunks: ``members(chunk, members array<long>)``, a cell a chunk, the features each tile sends to a chunk, the number of rows."""

    members: DataFrame
    cells: DataFrame
    needs: DataFrame
    n: int


def cells(long: DataFrame, ids: DataFrame) -> Cells:
    """The cells of the rows ``ids``; ids without entries are rows of zeros."""
    n, entries = ids.count(), long.count()
    chunks = max(1, math.ceil(n / CHUNK_ROWS), math.ceil(entries / CHUNK_ENTRIES), min(FEW_CHUNKS, entries // FEW_ENTRIES))
    rows = ids.select("id").join(sparse_rows(long), "id", "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("long"))
    held = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("id", "ix", "vx"))).alias("held"))
    names = [*[c.split()[0] for c in CELL.split(", ")], "members"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch["held"].slice(r, 1).flatten()
                lens = docs.field("ix").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                cols = docs.field("ix").drop_null().flatten().to_numpy(zero_copy_only=False)
                vals = docs.field("vx").drop_null().flatten().to_numpy(zero_copy_only=False)
                feats, own = np.unique(cols.astype(np.int32), return_inverse=True)
                place = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
                by = np.argsort(own, kind="stable")
                held = [feats.tobytes(), place[by].tobytes(), own[by].astype(np.int32).tobytes(), vals[by].tobytes(), None, docs.field("id").to_pylist()]
                yield _batch(names, kinds, [(batch["chunk"][r].as_py(), -1, len(lens), *held)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            feats = np.frombuffer(row["feats"], np.int32)
            found = [(t, row["chunk"] // LOT, row["chunk"], (feats[at] - t * TILE).tobytes()) for t, at in _by_tile(feats)]
            yield _batch(["tile", "lot", "chunk", "at"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()], found)

    cut_ = reliable_checkpoint(held.mapInArrow(cut, f"{CELL}, members array<long>"))
    asked = cut_.select("chunk", "feats").mapInArrow(ask, NEED).groupBy("tile", "lot").agg(F.sort_array(F.collect_list(F.struct("chunk", "at"))).alias("asked"))
    return Cells(cut_.select("chunk", "members"), cut_.drop("members"), reliable_checkpoint(asked), n)


def _by_tile(feats: np.ndarray) -> list[tuple[int, slice]]:
    """The tiles of sorted features and the places of each."""
    tiles, starts = np.unique(feats // TILE, return_index=True)
    ends = np.append(starts[1:], len(feats))
    return [(t, slice(i, j)) for t, i, j in zip(tiles.tolist(), starts.tolist(), ends.tolist())]


def _add_products(out: np.ndarray, to: np.ndarray, matrix: np.ndarray, via: np.ndarray, vals: np.ndarray) -> None:
    """out[to] += vals * matrix[via], in strips of sorted targets."""
    by = np.argsort(to, kind="stable")
    to, via, vals = to[by], via[by], vals[by]
    for at in range(0, len(to), STRIP):
        here = to[at : at + STRIP]
        heads = np.nonzero(np.diff(here, prepend=-1))[0]
        out[here[heads]] += np.add.reduceat(matrix[via[at : at + STRIP]] * vals[at : at + STRIP, None], heads, axis=0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def summed(parts: DataFrame, key: str) -> DataFrame:
    """``(key, data)``: the matrices of each key added up in a fixed order of their sources."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def out() -> pa.RecordBatch:
            return _batch([key, "data"], [pa.int64(), pa.binary()], [(last, total.tobytes())])

        for row in _rows(batches):
            if row[key] != last:
                if last is not None:
                    yield out()
                last, total = row[key], np.zeros(len(row["data"]) // 8)
            total += np.frombuffer(row["data"])
        if last is not None:
            yield out()

    return parts.repartition(key).sortWithinPartitions(key, "source").mapInArrow(add, f"{key} long, data binary")


def _with_tiles(cells_: Cells, tiles: DataFrame, width: int) -> DataFrame:
    """The cells, each followed by the rows of the matrix that it needs, in the order of its features."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            matrix = np.frombuffer(row["data"]).reshape(TILE, width)
            for a in row["asked"]:
                data = matrix[np.frombuffer(a["at"], np.int32)].tobytes()
                yield _batch(["chunk", "tile", "data"], [pa.int64(), pa.int64(), pa.binary()], [(a["chunk"], row["tile"], data)])

    sent = cells_.needs.join(tiles, "tile").mapInArrow(send, "chunk long, tile long, data binary")
    both = cells_.cells.unionByName(sent, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "tile")


def _products(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Each cell of ``_with_tiles`` and its rows times the matrix, of which ``block`` rows and those of a tile are held at most."""
    kinds = {"feats": np.int32, "rows": np.int32, "cols": np.int32, "vals": np.float64}
    cell, y, held, done, at = None, None, [], 0, 0

    def multiply() -> None:
        own = _entries(cell, done, at)
        _add_products(y, cell["rows"][own], np.concatenate(held), cell["cols"][own] - done, cell["vals"][own])

    for row in _rows(batches):
        if row["tile"] == -1:
            if held:
                multiply()
            if cell is not None:
                yield cell, y
            cell = {"chunk": row["chunk"], "size": row["size"], **{c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}}
            y, held, done, at = np.zeros((cell["size"], width)), [], 0, 0
        else:
            held.append(np.frombuffer(row["data"]).reshape(-1, width))
            at += len(held[-1])
            if at - done >= block:
                multiply()
                held, done = [], at
    if held:
        multiply()
    if cell is not None:
        yield cell, y


def _entries(cell: dict, start: int, stop: int) -> slice:
    """The entries of the cell's features from ``start`` to ``stop``."""
    return slice(*np.searchsorted(cell["cols"], [start, stop]).tolist())


def product(cells_: Cells, tiles: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """X Q: ``(chunk, data)``, the rows of each chunk times the matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, y in _products(batches, width, block):
            yield _batch(["chunk", "data"], [pa.int64(), pa.binary()], [(cell["chunk"], y.tobytes())])

    return _with_tiles(cells_, tiles, width).mapInArrow(multiply, "chunk long, data binary")


def crossed(cells_: Cells, tiles: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """X' X Q: ``(tile, data)``, summed over all rows in the order of their chunks."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, y in _products(batches, width, block):
            for start in range(0, len(cell["feats"]), block):
                feats = cell["feats"][start : start + block]
                own = _entries(cell, start, start + block)
                back = np.zeros((len(feats), width))
                _add_products(back, cell["cols"][own] - start, y, cell["rows"][own], cell["vals"][own])
                for t, at in _by_tile(feats):
                    row = (t, cell["chunk"], (feats[at] - t * TILE).tobytes(), back[at].tobytes())
                    yield _batch(["tile", "source", "at", "data"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], [row])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for row in _rows(batches):
            if row["tile"] != last:
                if last is not None:
                    yield _batch(["tile", "data"], [pa.int64(), pa.binary()], [(last, total.tobytes())])
                last, total = row["tile"], np.zeros((TILE, width))
            total[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["data"]).reshape(-1, width)
        if last is not None:
            yield _batch(["tile", "data"], [pa.int64(), pa.binary()], [(last, total.tobytes())])

    parts = _with_tiles(cells_, tiles, width).mapInArrow(multiply, "tile long, source long, at binary, data binary")
    return parts.repartition("tile").sortWithinPartitions("tile", "source").mapInArrow(add, "tile long, data binary")


def _map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], width: int, keep: str = "") -> DataFrame:
    """Each tile's matrix through ``fn(matrix, row)``."""
    names = [c.split()[0] for c in keep.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = fn(np.frombuffer(row["data"]).reshape(TILE, width), row)
            yield _batch(["tile", "data", *names], [pa.int64(), pa.binary(), *[pa.binary()] * len(names)], [(row["tile"], np.ascontiguousarray(out).tobytes(), *[row[c] for c in names])])

    return tiles.mapInArrow(run, "tile long, data binary" + (f", {keep}" if keep else ""))


def _total(tiles: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], width: int) -> np.ndarray:
    """Sum over the tiles of a small matrix; a task adds up its own, the driver one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row in _rows(batches):
            part = fn(np.frombuffer(row["data"]).reshape(TILE, width), row)
            total = part if total is None else total + part
        if total is not None:
            yield _batch(["data"], [pa.binary()], [(total.tobytes(),)])

    found = tiles.coalesce(32).mapInArrow(run, "data binary").collect()
    return sum(np.frombuffer(r["data"]) for r in found)


def _orthonormal(tiles: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The same column space with orthonormal columns, directions of no weight left out."""
    turns: list[np.ndarray] = []
    for _ in range(2):  # the second pass repairs what rounding left in the first
        def gram_of(m: np.ndarray, _: dict) -> np.ndarray:
            m = _turned(m, turns)
            return (m.T @ m).ravel()

        gram = _total(tiles, gram_of, width)
        gram = gram.reshape(math.isqrt(len(gram)), -1)
        weight, turn = np.linalg.eigh(gram)
        some = weight > 1e-14 * max(weight.max(), 1e-300)
        if not some.any():
            return tiles, width  # rows without variance
        turns.append(turn[:, some] / np.sqrt(weight[some]))
    return reliable_checkpoint(_map_tiles(tiles, lambda m, _: _turned(m, turns), width)), turns[-1].shape[1]


def _turned(matrix: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    for t in turns:
        matrix = matrix @ t
    return matrix


def fit(long: DataFrame, ids: DataFrame, n_features: int, components: int, seed: int = 17, block: int = BLOCK) -> Reduction:
    """Axes of the ``components`` largest variances of the rows ``ids`` (at most as many as rows or features)."""
    spark = long.sparkSession
    parts = cells(long, ids)
    n = parts.n
    k = max(1, min(n, n_features, components))
    width = max(1, min(k + OVERSAMPLE, n_features))
    n_tiles = max(1, math.ceil(n_features / TILE))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m = np.random.default_rng([seed, row["id"]]).standard_normal((TILE, width))
            m[max(0, n_features - row["id"] * TILE) :] = 0.0
            yield _batch(["tile", "data"], [pa.int64(), pa.binary()], [(row["id"], m.tobytes())])

    sums = long.groupBy("idx").agg((F.sum("value") / n).alias("mean"))
    entry = F.sort_array(F.collect_list(F.struct((F.col("idx") % TILE).alias("at"), "mean")))
    mean = spark.range(n_tiles).withColumnRenamed("id", "tile").join(sums.groupBy(F.expr(f"cast(idx div {TILE} AS long)").alias("tile")).agg(entry.alias("entries")), "tile", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m = np.zeros(TILE)
            for e in row["entries"] or []:
                m[e["at"]] = e["mean"]
            yield _batch(["tile", "mean"], [pa.int64(), pa.binary()], [(row["tile"], m.tobytes())])

    mean = reliable_checkpoint(mean.mapInArrow(pack, "tile long, mean binary"))
    drawn = reliable_checkpoint(spark.range(n_tiles).mapInArrow(draw, "tile long, data binary"))
    basis, width = _orthonormal(drawn, width)
    if basis is not drawn:
        drop_checkpoints(drawn)
    for turn in range(POWER + 1):
        both = basis.join(mean, "tile")
        c = _total(both, lambda m, row: np.frombuffer(row["mean"]) @ m, width)
        image = mean.join(crossed(parts, basis, width, block).withColumnRenamed("data", "p"), "tile", "left")

        def centred(batches: Iterator[pa.RecordBatch], c=c, width=width) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                p = np.frombuffer(row["p"]).reshape(TILE, width) if row["p"] is not None else 0.0
                m = p - n * np.outer(np.frombuffer(row["mean"]), c)
                yield _batch(["tile", "data"], [pa.int64(), pa.binary()], [(row["tile"], m.tobytes())])

        image = reliable_checkpoint(image.mapInArrow(centred, "tile long, data binary"))
        if turn < POWER:
            last = basis
            basis, width = _orthonormal(image, width)
            drop_checkpoints(last, *([image] if basis is not image else []))
    pairs = basis.join(image.withColumnRenamed("data", "image"), "tile")
    gram = _total(pairs, lambda m, row: (m.T @ np.frombuffer(row["image"]).reshape(TILE, width)).ravel(), width).reshape(width, width)
    weight, turn = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-weight)[:k]
    weight, turn = weight[order], turn[:, order]
    some = weight > NO_VARIANCE * max(weight.max(initial=0.0), 1e-300)
    scale = np.where(some, np.sqrt(n / np.where(some, weight, 1.0)), 0.0)
    axis = np.zeros((width, k))
    axis[:, : len(order)] = turn * scale
    tiles = _map_tiles(basis.join(mean, "tile"), lambda m, _: m @ axis, width, "mean binary")
    axes = reliable_checkpoint(_unpacked(tiles, k, n_features))
    drop_checkpoints(basis, image, mean, parts.cells, parts.needs)
    return Reduction(axes, k, n_features)


def _unpacked(tiles: DataFrame, k: int, n_features: int) -> DataFrame:
    """One row a feature: idx, mean, axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m = np.frombuffer(row["data"]).reshape(TILE, k)
            here = min(TILE, n_features - row["tile"] * TILE)
            idx = row["tile"] * TILE + np.arange(here)
            mean = np.frombuffer(row["mean"])[:here]
            yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), pa.array(mean), pa.array(list(m[:here]), pa.list_(pa.float64()))], ["idx", "mean", "axis"])

    return tiles.mapInArrow(run, "idx int, mean double, axis array<double>")


def _packed(red: Reduction) -> DataFrame:
    """The axes as tiles."""
    k = red.components
    entry = F.sort_array(F.collect_list(F.struct((F.col("idx") % TILE).alias("at"), "axis")))
    held = red.axes.groupBy(F.expr(f"cast(idx div {TILE} AS long)").alias("tile")).agg(entry.alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m = np.zeros((TILE, k))
            for e in row["entries"]:
                m[e["at"]] = e["axis"]
            yield _batch(["tile", "data"], [pa.int64(), pa.binary()], [(row["tile"], m.tobytes())])

    return held.mapInArrow(run, "tile long, data binary")


def project(red: Reduction, long: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id, reduced array<double>`` of the rows ``ids``."""
    k = red.components
    parts = cells(long, ids)
    offset = [r["s"] for r in red.axes.select(F.posexplode(F.transform("axis", lambda a: a * F.col("mean"))).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()]
    shift = np.array(offset) if offset else np.zeros(k)
    done = parts.members.join(product(parts, _packed(red), k, block), "chunk", "left")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids_ = row["members"]
            m = np.frombuffer(row["data"]).reshape(len(ids_), k) if row["data"] is not None else np.zeros((len(ids_), k))
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(list(m - shift), pa.list_(pa.float64()))], ["id", "reduced"])

    return done.mapInArrow(unpack, "id long, reduced array<double>")


def moments(reduced: DataFrame) -> DataFrame:
    """``a, b, mean, covariance`` (a <= b) over ``id, reduced array<double>``, rows of the same id paired with each other.

    A task adds up the products of its rows as matrices, so no pair of components is ever a row for each document."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in batches:
            counts = batch["held"].value_lengths().to_numpy(zero_copy_only=False)
            if not len(counts):
                continue
            rows = batch["held"].flatten()
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            x = np.add.reduceat(x, np.cumsum(counts) - counts, axis=0)  # one row an id
            if sums is None:
                sums, products = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
            n, sums, products = n + int((counts * counts).sum()), sums + counts @ x, products + x.T @ x
        if sums is not None:
            a, b = np.triu_indices(len(sums))
            columns = [a, b, np.full(len(a), n), sums[a], sums[b], products[a, b]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "n", "x", "y", "xy"])

    held = reduced.where(F.col("id").isNotNull()).groupBy("id").agg(F.collect_list("reduced").alias("held")).select("held")
    total = held.mapInArrow(add, "a int, b int, n long, x double, y double, xy double").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])
    mean = {c: F.col(c) / F.col("n") for c in ("x", "y", "xy")}
    return total.select("a", "b", mean["x"].alias("mean"), (mean["xy"] - mean["x"] * mean["y"]).alias("covariance"))
