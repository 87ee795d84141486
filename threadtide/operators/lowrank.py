"""Truncated singular value decomposition of sparse rows in a fixed number of scans.

A block of random directions is multiplied by the Gram matrix of the rows, one scan a time; each product is made
orthogonal to all before it. In the space of all blocks the Gram matrix is a small one, whose eigenvectors give the
axes. A task adds up its share of a product and hands it on in slabs of columns, which are added where they meet,
one slab at a time. The number of columns is bounded by the vocabulary, so blocks and products pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EXTRA, BLOCKS, SLAB, ROWS = 10, 6, 256, 1024  # directions beyond the wanted; scans; columns of a slab; rows at once
Batches = Iterator[pa.RecordBatch]


class _Sparse:
    """Rows of (place, weight) lists as one sparse matrix."""

    def __init__(self, places: pa.Array, weights: pa.Array):
        self.length = np.diff(places.offsets.to_numpy())
        self.at = places.flatten().to_numpy(zero_copy_only=False)
        self.w = weights.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.length)), self.length)

    def on(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows times the basis; the columns they use and the rows over those, dense."""
        used = np.unique(self.at)
        dense = np.zeros((len(self.length), len(used)))
        dense[self.row, np.searchsorted(used, self.at)] = self.w
        return dense @ basis[used], used, dense


def _pieces(batches: Batches, first: int) -> Iterator[tuple[pa.RecordBatch, _Sparse]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, _Sparse(part.column(first), part.column(first + 1))


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'A times the block, for rows (at array<int>, w array<double>) of A."""
    columns, width = block.shape

    def products(batches: Batches) -> Batches:
        total = np.zeros((columns, width))
        for _, a in _pieces(batches, 0):
            product, used, dense = a.on(block)
            total[used] += dense.T @ product
        for low in range(0, columns, SLAB):
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([total[low : low + SLAB].tobytes()], pa.binary())], names=["slab", "part"])

    def added(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(part.as_buffer(), np.float64)
                sums[slab] = sums[slab] + x if slab in sums else x
        for slab, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slab", "part"])

    schema = "slab int, part binary"
    parts = rows.select("at", "w").mapInArrow(products, schema).repartition("slab").mapInArrow(added, schema)
    out = np.zeros((columns, width))
    for r in parts.collect():  # the columns times the block's width
        x = np.frombuffer(r["part"], np.float64).reshape(-1, width)
        out[r["slab"] : r["slab"] + len(x)] = x
    return out


def axes(rows: DataFrame, columns: int, dims: int, blocks: int = BLOCKS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first right singular vectors (columns by dims) and singular values of the rows."""
    width = min(columns, dims + EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    basis, images = np.zeros((columns, 0)), np.zeros((columns, 0))
    for _ in range(blocks):
        image = gram_product(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        left = min(width, columns - basis.shape[1])
        if left <= 0:
            break
        for _ in range(2):  # once more against what rounding leaves
            image = image - basis @ (basis.T @ image)
        block, kept, _ = np.linalg.svd(image, full_matrices=False)
        block = block[:, :left][:, kept[:left] > 1e-12 * max(1e-300, np.abs(images).max())]
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block = np.linalg.qr(block)[0]
    small = basis.T @ images
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(dims, len(values))]
    found = basis @ vectors[:, order]
    # the sign of an axis is free: its largest entry is positive
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found, np.sqrt(np.maximum(values[order], 0))


def projected(rows: DataFrame, key: str, basis: np.ndarray, name: str) -> DataFrame:
    """``key`` and ``name``, the rows (key, at, w) on the axes: one product per batch."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for part, a in _pieces(batches, 1):
            out, _, _ = a.on(basis)
            at = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=[key, name])

    return rows.select(key, "at", "w").mapInArrow(run, f"{key} {kind}, {name} array<double>")
