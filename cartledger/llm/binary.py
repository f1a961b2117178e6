"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank.

*Codes.*  Unit vectors are centred, projected on their principal axes and turned
by a rotation that iterative quantisation learns, so that components lie far
from zero; medians as offsets balance the bits.  A code is the signs.  Mean, axes,
rotation and offsets are learned from at most ``sample`` vectors (those with the
smallest hashes); every vector is coded and indexed, so the sample decides about
speed, not about results.

*Retrieval.*  Two unit vectors of cosine c lie sqrt(2 - 2c) apart, and no further
after projection and rotation.  A bit in which they differ costs at least the
squares of both their components there, so over the bits in which they differ
these sum up to at most 2 - 2c.  The code is cut into ``tables`` substrings; in one
of them, and for one of the two vectors, that sum is at most its share,
(2 - 2c) / (2 * tables).  Each vector therefore looks into its own bucket of every
table and into those it reaches by flipping bits of no more cost than the share:
no pair is lost.  A vector with very many such buckets looks into the buckets of
a shorter prefix of that substring instead, in the extreme into one of all
vectors of its label.  Tables are fewer, and substrings longer, the more vectors
a label has.

Inside the join the codes' Hamming distance is held against what sizes of
components allow; what is left is compared by cosine in double precision.

Equal vectors of a label are one class, which takes part once.  Buckets of more
than ``bucket`` classes are cut into shares, and what looks into them comes to
every share, so that one bucket meets in many tasks.  A group of different
vectors that are all linked has as many pairs as it has links; they are formed
once, as each is to be counted.

Defined results: a vector that is null, empty, all zero or holds a null or
non-finite component, or has a null label, is linked with nothing; neither are
vectors of different lengths; rows are vectors, and repeated rows are linked
with each other; a component's id is its smallest id, null if none has one; an
empty table has no rows.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.components import components
from cartledger.llm.hot import attached
from cartledger.llm.session import staged

_ROUNDING = 1e-9
_CODE_BITS, _PREFIX_BITS, _MOST_BITS = 34, 6, 32  # a bucket's key: table, prefix length, code
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Near:
    cosine: float = 0.98
    sample: int = 8192
    iterations: int = 40
    probes: int = 256  # buckets of one table a vector looks into before it takes a shorter prefix
    bucket: int = 1024

    @property
    def cost(self) -> float:
        """The largest squared distance of linked unit vectors."""
        return 2 - 2 * self.cosine + _ROUNDING


# -- codes, in numpy


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, padded with zeros."""
    out = np.zeros((len(vectors), width))
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(out)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


@dataclass
class Codec:
    """How a unit vector becomes components and their signs a code."""

    mean: np.ndarray
    turn: np.ndarray  # dimension by bit: principal axes, rotated
    offset: np.ndarray

    @classmethod
    def learned(cls, units: np.ndarray, iterations: int) -> "Codec":
        """Iterative quantisation over a sample of unit vectors."""
        width = units.shape[1]
        bits = min(width, 64)
        mean = units.mean(axis=0) if len(units) else np.zeros(width)
        centred = units - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        projected = centred @ axes
        rotation, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))
        for _ in range(iterations):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            rotation = left @ right
        offset = np.median(projected @ rotation, axis=0) if len(units) else np.zeros(bits)
        return cls(mean, axes @ rotation, offset)

    def components(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.turn - self.offset


@dataclass(frozen=True)
class Tables:
    """How a code is cut: ``count`` substrings of ``bits`` bits."""

    count: int
    bits: int

    @classmethod
    def suiting(cls, code_bits: int, largest_group: int) -> "Tables":
        wanted = max(4, int(largest_group).bit_length())
        count = max(1, min(8, code_bits // wanted))
        return cls(count, min(code_bits // count, _MOST_BITS))

    def prefixes(self) -> list[int]:
        return [self.bits, self.bits // 2, 0]

    def key(self, table: int, prefix: int, code: np.ndarray) -> np.ndarray:
        return (np.int64(((table << _PREFIX_BITS) | prefix) << _CODE_BITS)) | code


def flips(cost: np.ndarray, budget: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets of columns whose costs sum up to the budget at most: (row, bit mask), and rows with more than ``most``.

    Columns are taken from cheap to dear; a set is followed by itself with the
    next column added and by itself with the next column in place of its last, so
    each set is made once and from one that costs no more.
    """
    n, width = cost.shape
    order = np.argsort(cost, axis=1)
    price = np.take_along_axis(cost, order, axis=1)
    bit = np.int64(1) << order.astype(np.int64)
    owners, masks = [np.arange(n)], [np.zeros(n, np.int64)]
    counts = np.ones(n, np.int64)
    own = np.flatnonzero(price[:, 0] <= budget) if width else np.zeros(0, np.int64)
    last, total, mask = np.zeros(len(own), np.int64), price[own, 0] if width else np.zeros(0), bit[own, 0] if width else np.zeros(0, np.int64)
    while len(own):
        counts += np.bincount(own, minlength=n)
        fine = counts[own] <= most
        own, last, total, mask = own[fine], last[fine], total[fine], mask[fine]
        owners.append(own)
        masks.append(mask)
        more = np.flatnonzero(last + 1 < width)
        own, last, total, mask = own[more], last[more], total[more], mask[more]
        added = total + price[own, last + 1]
        moved = added - price[own, last]
        a, m = np.flatnonzero(added <= budget), np.flatnonzero(moved <= budget)
        added_mask = mask | bit[own, last + 1]
        moved_mask = added_mask ^ bit[own, last]
        own, last = np.concatenate([own[a], own[m]]), np.concatenate([last[a], last[m]]) + 1
        total, mask = np.concatenate([added[a], moved[m]]), np.concatenate([added_mask[a], moved_mask[m]])
    owner, mask = np.concatenate(owners), np.concatenate(masks)
    return owner, mask, counts > most


def looked_up(components: np.ndarray, tables: Tables, rule: Near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home keys by row and table), (row, key) of all buckets to look into."""
    share = rule.cost / (2 * tables.count)
    homes = np.zeros((len(components), tables.count), np.int64)
    owners, keys = [], []
    for t in range(tables.count):
        part = components[:, t * tables.bits : (t + 1) * tables.bits]
        code = ((part >= 0) << np.arange(tables.bits, dtype=np.int64)).sum(axis=1, dtype=np.int64)
        homes[:, t] = tables.key(t, tables.bits, code)
        rows = np.arange(len(components))
        for prefix in tables.prefixes():
            owner, mask, many = flips(part[rows, :prefix] ** 2, share, rule.probes)
            fine = ~many[owner]
            own = rows[owner[fine]]
            owners.append(own)
            keys.append(tables.key(t, prefix, (code[own] & ((1 << prefix) - 1)) ^ mask[fine]))
            rows = rows[many]
            if not len(rows):
                break
    return homes, np.concatenate(owners), np.concatenate(keys)


INDEXED = T.StructType(
    [T.StructField("code", T.LongType()), T.StructField("reach", T.IntegerType()),
     T.StructField("homes", T.ArrayType(T.LongType())), T.StructField("probes", T.ArrayType(T.LongType()))]
)


def _indexed(codec: Codec, tables: Tables, rule: Near, width: int):
    @F.arrow_udf(INDEXED)
    def indexed(vectors: pa.Array) -> pa.Array:
        z = codec.components(matrix(vectors, width))
        code = ((z >= 0).astype(np.uint64) << np.arange(z.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        # Linked vectors differ in no more bits than the cheapest bits of one of them cost half of all.
        reach = (np.cumsum(np.sort(z * z, axis=1), axis=1) <= rule.cost / 2).sum(axis=1)
        homes, owner, keys = looked_up(z, tables, rule)
        order = np.argsort(owner, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(z)))]).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * tables.count), pa.array(homes.ravel())),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[order])),
        ]
        return pa.StructArray.from_arrays([pa.array(code.view(np.int64)), pa.array(reach.astype(np.int32)), *lists], INDEXED.names)

    return indexed


def _cosine(width: int):
    @F.arrow_udf(T.DoubleType())
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", matrix(a, width), matrix(b, width)))

    return cosine


# -- on Spark


def _usable(label: Column, v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _described(embeddings: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector, key): the vector in double precision without negative zeros, null if unusable."""
    usable = _usable(F.col(label), F.col(vector))
    clean = F.when(usable, F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)))
    rows = embeddings.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), clean.alias("vector"))
    key = F.struct(F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2"))
    return rows.withColumn("key", F.when(F.col("vector").isNotNull(), key))


def _classes(described: DataFrame) -> DataFrame:
    """(cls, key, label, len, vector, first, n): equal vectors of a label as one."""
    grouped = described.where("vector IS NOT NULL").groupBy("key", "label", "vector")
    counted = grouped.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return staged(counted.withColumn("len", F.size("vector")).withColumn("cls", F.monotonically_increasing_id()), "binary_classes")


def _candidates(classes: DataFrame, width: int, rule: Near) -> DataFrame:
    """Pairs of classes (x, y), x < y, that share a bucket and whose codes allow the similarity."""
    sample = classes.orderBy(F.xxhash64("vector"), "cls").limit(rule.sample).select("vector").toArrow()
    codec = Codec.learned(matrix(sample.column(0).combine_chunks(), width), rule.iterations)
    largest = classes.groupBy("label", "len").count().agg(F.max("count")).first()[0]
    tables = Tables.suiting(codec.turn.shape[1], largest)
    coded = classes.select("cls", "label", "len", _indexed(codec, tables, rule, width)(F.col("vector")).alias("found"))
    coded = staged(coded.select("cls", "label", "len", "found.*"), "binary_codes")
    row = ["cls", "code", "reach"]
    probes = coded.select(*row, "label", "len", "homes", F.explode("probes").alias("key"))
    # Buckets of shorter prefixes are filled only where somebody looks into them.
    table_of = lambda key: F.shiftright(key, _CODE_BITS + _PREFIX_BITS)
    prefix_of = lambda key: F.shiftright(key, _CODE_BITS).bitwiseAND(F.lit((1 << _PREFIX_BITS) - 1))
    shorter = probes.where(prefix_of(F.col("key")) < tables.bits).select(
        F.struct("label", "len", table_of(F.col("key")).alias("table")).alias("part"), prefix_of(F.col("key")).cast("int").alias("prefix")
    )
    shorter = staged(shorter.groupBy("part").agg(F.collect_set("prefix").alias("prefixes")), "binary_prefixes")
    full = coded.select(*row, "label", "len", F.explode("homes").alias("key"))
    cut = attached(full.withColumn("part", F.struct("label", "len", table_of(F.col("key")).alias("table"))), shorter, "part")
    cut = cut.withColumn("prefix", F.explode("prefixes"))
    low = F.col("key").bitwiseAND(F.expr("shiftleft(1L, prefix) - 1"))
    cut_key = F.shiftleft(F.shiftleft(table_of(F.col("key")), _PREFIX_BITS).bitwiseOR(F.col("prefix").cast("long")), _CODE_BITS).bitwiseOR(low)
    homes = full.unionByName(cut.withColumn("key", cut_key).select(full.columns))

    bucket = F.struct("label", "len", "key")
    homes = homes.select(*row, bucket.alias("bucket"))
    own = F.array_contains("homes", F.col("key"))
    probes = probes.select(*row, bucket.alias("bucket"), own.alias("own"))
    sizes = homes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rule.bucket)
    hot = staged(sizes.select("bucket", F.ceil(F.col("n") / rule.bucket).cast("int").alias("shares")), "binary_hot")
    shares = F.coalesce("shares", F.lit(1))
    share = F.pmod(F.xxhash64("cls"), shares).cast("int")
    homes = attached(homes, hot, "bucket").select("bucket", share.alias("share"), *[F.col(c).alias(f"y_{c}") for c in row])
    probes = attached(probes, hot, "bucket").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    met = probes.join(homes, ["bucket", "share"]).where(
        F.when(F.col("own"), F.col("cls") < F.col("y_cls")).otherwise(F.col("cls") != F.col("y_cls"))
        & (F.bit_count(F.col("code").bitwiseXOR(F.col("y_code"))) <= F.greatest("reach", "y_reach"))
    )
    return met.select(F.least("cls", "y_cls").alias("x"), F.greatest("cls", "y_cls").alias("y")).distinct()


def _reranked(pairs: DataFrame, classes: DataFrame, width: int, rule: Near) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    vectors = staged(classes.select("cls", "vector").join(wanted, "cls", "left_semi"), "binary_vectors")
    small = vectors.count() * (8 * width + 64) <= BROADCAST_BYTES
    both = pairs
    for side in ("x", "y"):
        own = vectors.select(F.col("cls").alias(side), F.col("vector").alias(f"{side}_vector"))
        both = both.join(F.broadcast(own) if small else own, side)
    close = both.withColumn("cosine", _cosine(width)(F.col("x_vector"), F.col("y_vector")))
    return close.where(F.col("cosine") >= rule.cosine).select("x", "y", "cosine")


def links(classes: DataFrame, rule: Near = Near()) -> DataFrame:
    """All pairs of classes (x, y, cosine) of a label at or above the similarity, written once."""
    width = classes.agg(F.max("len")).first()[0]
    if width is None:
        return classes.sparkSession.createDataFrame([], "x long, y long, cosine double")
    pairs = staged(_candidates(classes, width, rule), "binary_pairs")
    return staged(_reranked(pairs, classes, width, rule), "binary_links")


def near_duplicates(
    embeddings: DataFrame, rule: Near = Near(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: the id, n_links and component_id."""
    described = _described(embeddings, vec_id, vector, label)
    classes = _classes(described)
    found = links(classes, rule)
    both = found.select("x", "y").unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
    copies = staged(classes.where("n > 1").select(F.col("cls").alias("y"), (F.col("n") - 1).alias("more")), "binary_copies")
    degrees = attached(both, copies, "y").groupBy("x").agg(F.sum(F.coalesce("more", F.lit(0)) + 1).alias("degree"))
    labels = components(found)
    grouped = labels.join(classes.select(F.col("cls").alias("node"), "first"), "node")
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = labels.join(first, "component").join(degrees, F.col("node") == F.col("x")).select("node", "component_id", "degree")
    notable = classes.join(linked, F.col("cls") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL").select(
        "key",
        (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"),
        F.lit(True).alias("notable"),
    )
    rows = attached(described.select("id", "key"), staged(notable, "binary_notable"), "key")
    return rows.select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("notable"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
