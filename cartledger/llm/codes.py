"""Vector code compression: product codes, assigned through memoised grid cells.

A vector becomes integers (floor of 1024 times each component) and is cut into
consecutive parts of equal length.  Each part position has a codebook of at
first the parts of the smallest ids; rounds of nearest-entry assignment and
floored means refine it, all in integers, so that results do not depend on the
order of additions.

*Memoised cells.*  A part lies in a cell of a coarse grid.  Over the cell's box
an entry has a least and a greatest distance; an entry whose least distance is
above the smallest greatest distance of any entry is dominated in the whole box
and cannot be nearest to anything in it.  The entries that are left are kept for
the cell, and only they are evaluated exactly for the parts that lie in it.
Distances over a box are sums over dimensions, so those of many new cells are put
together from tables of (grid step, entry) per dimension.  The cells a task remembers are bounded;
those longest unused go first.

A task sends one row of sums per used entry and position; the codebooks
(entries times dimensions) and the first ids are all that reaches the driver.

Defined results: a vector that is null, empty or holds a null or non-finite
component is left out, as is one whose length is not that of the first vector
by id or cannot be cut into the parts; integers beyond 2^24 either way count as
2^24; rows are vectors, repeated or not, and of equal ids those with smaller
integers come first, a null id last; ties go to the lower index; null labels
are one label; an empty table has no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.hot import attached
from cartledger.llm.session import staged

SCALE = 1024
LARGEST = 1 << 24
_PAIRS = 1 << 16  # (part, entry) pairs evaluated at a time
_CELLS = 512  # cells looked at for the first time, at a time


@dataclass(frozen=True)
class Coding:
    parts: int = 4
    entries: int = 256  # at most 256, as an index is one byte
    rounds: int = 4
    cell: int = 64  # side of a grid cell, in integers
    cells: int = 20_000  # remembered by a task for each part position


# -- inside tasks


class Cells:
    """The entries of one codebook that can be nearest somewhere in a cell, by cell."""

    def __init__(self, book: np.ndarray, side: int, most: int):
        self._book, self._side, self._most = book, side, most
        self._young: dict[bytes, np.ndarray] = {}
        self._old: dict[bytes, np.ndarray] = {}

    def _survivors(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries whose least distance is not above the smallest greatest one."""
        least = np.zeros((len(cells), len(self._book)), np.int64)
        greatest = np.zeros_like(least)
        for dimension, values in enumerate(self._book.T):
            steps, place = np.unique(cells[:, dimension], return_inverse=True)
            below = steps[:, None] * self._side - values
            above = values - (steps[:, None] * self._side + self._side - 1)
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[place]
            greatest += (np.maximum(-below, -above) ** 2)[place]
        cell, entry = np.nonzero(least <= greatest.min(axis=1, keepdims=True))
        return np.split(entry, np.cumsum(np.bincount(cell, minlength=len(cells)))[:-1])

    def of(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each of some distinct cells the indexes of its entries, ascending."""
        keys = [cell.tobytes() for cell in cells]
        found = [self._young.get(key, self._old.get(key)) for key in keys]
        unknown = [i for i, entries in enumerate(found) if entries is None]
        for at in range(0, len(unknown), _CELLS):
            some = unknown[at : at + _CELLS]
            for i, entries in zip(some, self._survivors(cells[some])):
                found[i] = entries
        for key, entries in zip(keys, found):
            if 2 * len(self._young) >= self._most:
                self._old, self._young = self._young, {}
            self._young[key] = entries
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each part."""
        best, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if not len(parts):
            return best, distance
        cells, cell_of = np.unique(parts // self._side, axis=0, return_inverse=True)
        kept = self.of(cells)
        sizes = np.array([len(k) for k in kept])
        entries, first = np.concatenate(kept), np.concatenate([[0], np.cumsum(sizes)])
        counts = sizes[cell_of]
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(parts):
            done = ends[begin] - counts[begin]
            end = max(begin + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
            own = counts[begin:end]
            starts = np.concatenate([[0], np.cumsum(own)[:-1]])
            offset = np.arange(own.sum()) - np.repeat(starts, own)
            entry = entries[np.repeat(first[cell_of[begin:end]], own) + offset]
            gap = np.repeat(parts[begin:end], own, axis=0) - self._book[entry]
            apart = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(apart, starts)
            hits = np.flatnonzero(apart == np.repeat(least, own))
            owner = np.searchsorted(starts, hits, "right") - 1
            _, lowest = np.unique(owner, return_index=True)
            best[begin:end], distance[begin:end] = entry[hits[lowest]], least
            begin = end
        return best, distance


class Coder:
    """Assigns whole vectors under the codebooks of all positions."""

    def __init__(self, books: np.ndarray, coding: Coding):
        self._cells = [Cells(book, coding.cell, coding.cells) for book in books]

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (vector, position) and squared distances, same shape."""
        cut = vectors.reshape(len(vectors), len(self._cells), -1)
        found = [cells.nearest(np.ascontiguousarray(cut[:, p])) for p, cells in enumerate(self._cells)]
        return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# -- on Spark


def integers(embeddings: DataFrame, coding: Coding, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the vectors that are coded, written once, and their length."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)))
    cuttable = (F.size(v) > 0) & (F.size(v) % coding.parts == 0)
    rows = embeddings.where(v.isNotNull() & whole & cuttable).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled.alias("ints")
    )
    rows = staged(rows, "codes_integers")
    first = rows.orderBy(*_by_id()).select(F.size("ints")).first()
    width = first[0] if first else 0
    return rows.where(F.size("ints") == width), width


def _by_id() -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.col("ints").asc()]


def _refined(rows: DataFrame, books: np.ndarray, coding: Coding) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts nearest to it."""
    parts, entries, length = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, coding)
        totals, counts = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * length)
            index, _ = coder(vectors)
            cut = vectors.reshape(len(vectors), parts, length)
            for p in range(parts):
                np.add.at(totals[p], index[:, p], cut[:, p])
                counts[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        flat = totals[part, entry]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(flat[:, i]) for i in range(length)], names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(length)]]
    schema = "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    summed = rows.select("ints").mapInArrow(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    books = books.copy()
    for row in summed.collect():  # at most one row per entry
        books[row[0], row[1]] = [total // row[2] for total in row[3:]]
    return books


def trained(rows: DataFrame, width: int, coding: Coding = Coding()) -> np.ndarray:
    """The codebooks (position, entry, component) after all rounds."""
    first = rows.orderBy(*_by_id()).limit(coding.entries).collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), coding.parts, width // coding.parts)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    for _ in range(coding.rounds if first else 0):
        books = _refined(rows, books, coding)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CODED = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])


def _coded(books: np.ndarray, coding: Coding):
    memory: list[Coder] = []  # one per worker, so that cells outlive a batch

    @F.arrow_udf(CODED)
    def coded(vectors: pa.Array) -> pa.Array:
        if not memory:
            memory.append(Coder(books, coding))
        index, distance = memory[0](_matrix(vectors, books.shape[0] * books.shape[2]))
        codes = pa.array([row.tobytes() for row in index.astype(np.uint8)], pa.binary())
        return pa.StructArray.from_arrays([codes, pa.array(distance.sum(axis=1), pa.int64())], CODED.names)

    return coded


@dataclass
class Compressed:
    rows: DataFrame  # vec_id, label, code (binary, one byte per position), error, label_error
    books: np.ndarray  # position, entry, component


def compress(
    embeddings: DataFrame,
    coding: Coding = Coding(),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> Compressed:
    rows, width = integers(embeddings, coding, vec_id, vector, label)
    books = trained(rows, width, coding)
    coded = rows.select("vec_id", "label", _coded(books, coding)(F.col("ints")).alias("found"))
    coded = staged(coded.select("vec_id", "label", "found.*"), "codes_assigned")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return Compressed(attached(coded, staged(totals, "codes_labels"), "label"), books)


def restored(rows: DataFrame, books: np.ndarray, code: str = "code", into: str = "vector") -> DataFrame:
    """Add the vector that a code stands for (the middle of each integer's interval)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(codes: pa.Array) -> pa.Array:
        out = []
        for value in codes:
            index = np.frombuffer(value.as_py() or b"", np.uint8)
            known = len(index) == len(books)
            out.append(((books[np.arange(len(index)), index] + 0.5) / SCALE).ravel() if known else None)
        return pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn(into, vectors(F.col(code)))
