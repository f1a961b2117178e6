"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles as 64-bit hashes; documents with
equal sets form a class, of which one stands for all in what follows.

*Sketch.*  A set is spread by the high bits of its hashes over k lanes, and each
lane holds the XOR of its hashes.  A shingle that only one of two sets has can
change one lane, so the number of lanes that differ (the sketches' Hamming
distance, lane by lane) is at most the size of the symmetric difference.  Two
sets of a and b shingles that reach the similarity differ in at most
d = floor((1-t)/(1+t) * (a+b)) shingles.

*Pigeonhole join.*  Sets fall in size bands; a set sketches for its own band, and
for the one below if a partner may lie there.  A band has more lanes than d, so
linked sets agree in a lane.  If a set has more than d lanes that are not empty,
it even agrees with each partner in one of those, and empty lanes are not
joined; only sets for which that fails (a few very small ones) join empty lanes
too.

*Frequent lanes.*  Lanes made of boilerplate alone are shared by many sets.  A set
whose other lanes already number more than d does not need them; otherwise it
uses as many as are missing, rarest first in an order that is the same for all
(the prefix principle), so no link is lost.  In the frequent lanes that remain,
sets are first compared with the smallest of the lane.  Sets that then still lie
in different components are joined by their rarest shingles: with these counted
and put in one order, rarest first, linked sets of a and b shingles share one
among the first a - ceil(t a) + 1 of each, and behind it enough for the overlap
they need.  A passage that many share comes last in that order and joins nothing.

*Verify.*  A second sketch of 1024 bits, one of which each shingle flips, gives
another lower bound of the difference; candidates that pass it are checked on
their whole sets.

Defined results: words are the runs without white space, A-Z lowered; a text
with fewer words than the width is one shingle; a text without words or a null
has an empty set and is linked with nothing; rows are documents, repeated or
not; a component's id is its smallest document id, null if none has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartledger.llm.components import components
from cartledger.llm.native import unused
from cartledger.llm.pieces import LOWER, SMALL_PIECE, Piece, give_back, hashes, mixed, pieces, windows, words
from cartledger.llm.session import staged

MAX_SIZE = 1 << 40


@dataclass(frozen=True)
class Similarity:
    """Linked when 100 * intersection >= percent * union; sets of ``width`` words' shingles."""

    percent: int = 75
    width: int = 5
    frequent: int = 16  # sets in a lane above which it is used only where needed
    dealt: int = 256  # sets that have a shingle for each task in which they meet
    broadcast_rows: int = 1_000_000  # keys of candidates up to which documents are not shuffled

    def difference(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, a):
        return a * 100 // self.percent

    def smallest(self, a):
        return -(-a * self.percent // 100)


@lru_cache
def bands(rule: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """First size and number of lanes of each band; a partner lies at most one band below."""
    starts, lanes = [1], []
    while starts[-1] < MAX_SIZE:
        low = starts[-1]
        starts.append(max(low + 1, -(-low * 16 // 9), -(-low * 100 // rule.percent)))
        top = starts[-1] - 1
        most = rule.difference(top, rule.largest(top))
        lanes.append(most + most // 7 + 2)
    return np.array(starts[:-1], np.int64), np.array(lanes, np.int64)


@dataclass
class Sets:
    """Sorted distinct shingles of the texts of a piece, one text after the other."""

    values: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def classes(self) -> np.ndarray:
        """A 64-bit name of each set."""
        names = np.zeros(len(self.bounds) - 1, np.int64)
        for i in range(len(names)):
            own = self.values[self.bounds[i] : self.bounds[i + 1]]
            names[i] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
        return names


def shingle_sets(piece: Piece, width: int) -> Sets:
    starts, ends, first = words(piece)
    codes = hashes(LOWER[piece.data], starts, ends)
    found, at = windows(codes, first, width)
    counts = np.diff(first)
    n_windows = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        sizes = n_windows.copy()
        sizes[short] = 1
        values = np.zeros(int(sizes.sum()), np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.ones(len(values), bool)
        whole[bounds[short]] = False
        values[whole] = found
        for i in short:
            value = np.array([counts[i]], np.uint64)
            for code in codes[first[i] : first[i + 1]]:
                value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + code)
            values[bounds[i]] = value[0]
    else:
        values, bounds = found.copy(), np.concatenate([[0], np.cumsum(n_windows)])
    for i in range(len(piece)):
        values[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return Sets(values[new], kept[bounds])


def _lanes(sets: Sets, chosen: np.ndarray, band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature of every lane that is not empty of the chosen sets, and the set it belongs to."""
    sizes = sets.sizes[chosen]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    ends = np.cumsum(sizes)
    at = np.arange(len(owner)) - np.repeat(ends - sizes, sizes) + np.repeat(sets.bounds[chosen], sizes)
    values = sets.values[at]
    lane = ((values >> np.uint64(32)) * k[owner].astype(np.uint64)) >> np.uint64(32)
    begins = np.ones(len(values), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (lane[1:] != lane[:-1])
    begins = np.flatnonzero(begins)
    content = np.bitwise_xor.reduceat(values, begins)
    return _signature(content, band[owner[begins]], lane[begins]), owner[begins]


def _signature(content: np.ndarray, band: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """One number for (band, lane, content); its lowest bit tells odd bands from even ones."""
    band = band.astype(np.uint64)
    signature = mixed(content ^ mixed((band << np.uint64(44)) + lane))
    return (signature & ~np.uint64(1)) | (band & np.uint64(1))


def _sketches(sets: Sets, rule: Similarity) -> Iterator[tuple]:
    """For the own band and the one below: (own?, sets, filled lanes, lanes not needed, signatures, their sets).

    The number of lanes not needed is negative for a set that has to join its
    empty lanes; their signatures are then among those returned.
    """
    firsts, lanes = bands(rule)
    sizes = sets.sizes
    band = np.searchsorted(firsts, sizes, "right") - 1
    for own in (True, False):
        if own:
            most = rule.difference(sizes, rule.largest(sizes))
            chosen = np.flatnonzero((sizes > 0) & (most > 0))
        else:
            below = firsts[np.maximum(band, 0)] - 1
            most = rule.difference(sizes, below)
            chosen = np.flatnonzero((band > 0) & (rule.smallest(sizes) <= below) & (most > 0))
        b = band[chosen] - (not own)
        k = lanes[b]
        signatures, owner = _lanes(sets, chosen, b, k)
        full = np.bincount(owner, minlength=len(chosen))
        spare = full - most[chosen] - 1
        extra, extra_owner = [], []
        for i in np.flatnonzero(spare < 0):
            values = sets.values[sets.bounds[chosen[i]] : sets.bounds[chosen[i] + 1]]
            used = ((values >> np.uint64(32)) * np.uint64(k[i])) >> np.uint64(32)
            empty = np.setdiff1d(np.arange(k[i], dtype=np.uint64), used)
            extra.append(_signature(np.zeros(len(empty), np.uint64), np.full(len(empty), b[i]), empty))
            extra_owner.append(np.full(len(empty), i))
        if extra:
            signatures, owner = np.concatenate([signatures, *extra]), np.concatenate([owner, *extra_owner])
        yield own, chosen, full, spare, signatures, chosen[owner]


BITS = [f"bits{i}" for i in range(16)]
SHAPE = ["band", "spare_own", "spare_below", "lanes_own", "lanes_below"]
CLASS = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()),
     *[T.StructField(c, T.IntegerType()) for c in SHAPE],
     *[T.StructField(c, T.LongType()) for c in BITS]]
)


def _parities(sets: Sets) -> np.ndarray:
    """A bit sketch of each set: every shingle flips one of its bits."""
    size = 64 * len(BITS)
    owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    spot = owner * size + (mixed(sets.values) % np.uint64(size)).astype(np.int64)
    flips = np.bincount(spot, minlength=len(sets.sizes) * size).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").view("<i8").reshape(len(sets.sizes), len(BITS))


def _described(rule: Similarity):
    @F.arrow_udf(CLASS)
    def described(texts: pa.Array) -> pa.Array:
        out = [[] for _ in CLASS.names]
        for piece in pieces(texts, SMALL_PIECE):
            sets = shingle_sets(piece, rule.width)
            spares, filled = {}, {}
            for own, chosen, full, spare, _, _ in _sketches(sets, rule):
                spares[own], filled[own] = np.zeros((2, len(piece)), np.int32)
                spares[own][chosen], filled[own][chosen] = spare, full
            band = np.searchsorted(bands(rule)[0], sets.sizes, "right") - 1
            names = pa.array(sets.classes(), pa.int64(), mask=sets.sizes == 0)
            bits = _parities(sets)
            shape = (band, spares[True], spares[False], filled[True], filled[False])
            for column, part in zip(out, (sets.sizes, names, *shape, *bits.T)):
                column.append(pa.array(part))
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * len(SHAPE), *[pa.int64()] * len(BITS)]
        columns = [
            pa.concat_arrays([c.cast(kind) for c in parts]) if parts else pa.array([], kind)
            for parts, kind in zip(out, kinds)
        ]
        return pa.StructArray.from_arrays(columns, CLASS.names)

    return described


def _signatures(texts: DataFrame, rule: Similarity) -> DataFrame:
    """(sig, class) of every lane to join; within a task each class comes once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch.column(0), SMALL_PIECE):
                sets = shingle_sets(piece, rule.width)
                names = sets.classes()
                new = np.zeros(len(names), bool)
                for i, name in enumerate(names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        new[i] = True
                for *_, signatures, owner in _sketches(sets, rule):
                    own = new[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signatures[own].view(np.int64)), pa.array(names[owner[own]])], ["sig", "class"]
                    )

    return texts.mapInArrow(emit, "sig long, class long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, class), those whose signature two classes have; keeps one row in memory."""
    held = np.zeros((0, 2), np.int64)  # the last row, not yet known to be shared
    told = False  # whether it has been given out
    for batch in batches:
        rows = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        told = told and len(held) > 0
        rows = rows[new]
        same = rows[1:, 0] == rows[:-1, 0]
        out = np.zeros(len(rows), bool)
        out[1:] |= same
        out[:-1] |= same
        if told:
            out[0] = False
        last_told = bool(out[-1]) or (told and len(rows) == 1)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[out, 0]), pa.array(rows[out, 1])], ["sig", "class"])
        held, told = rows[-1:], last_told
    give_back()


@dataclass
class Lanes:
    """The lanes that two classes or more have."""

    few: DataFrame  # (sig, class) of ordinary lanes
    many: DataFrame  # (sig, class) of frequent lanes, for the sets that need them
    crowded: DataFrame  # (class, own, n_frequent): how many lanes of a set are frequent


def _lanes_to_join(signatures: DataFrame, classes: DataFrame, rule: Similarity) -> Lanes:
    shared = signatures.repartition("sig").sortWithinPartitions("sig", "class").mapInArrow(_shared, "sig long, class long")
    shared = staged(shared, "jaccard_shared")
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > rule.frequent)
    sizes = staged(sizes, "jaccard_frequent")
    common = shared.join(sizes, "sig").join(classes.select("class", "band", "spare_own", "spare_below"), "class")
    own = F.col("sig").bitwiseAND(F.lit(1)) == F.col("band").bitwiseAND(F.lit(1))
    spare = F.when(own, F.col("spare_own")).otherwise(F.col("spare_below"))
    per_set = Window.partitionBy("class", "own")  # bounded by the lanes of one set
    placed = (
        common.select("sig", "class", "size", own.alias("own"), spare.alias("spare"))
        .withColumn("place", F.row_number().over(per_set.orderBy("size", "sig")))
        .withColumn("n_frequent", F.count(F.lit(1)).over(per_set))
    )
    placed = staged(placed, "jaccard_common")
    return Lanes(
        shared.join(sizes.select("sig"), "sig", "left_anti"),
        placed.where(F.col("place") <= F.col("n_frequent") - F.col("spare")).select("sig", "class"),
        placed.where("place = 1").select("class", "own", "n_frequent"),
    )


def _plausible(pairs: DataFrame, classes: DataFrame, crowded: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs (x, y, n_shared) whose sizes, lanes and bit sketches allow the similarity.

    Of the lanes of either set at most the difference may lack in the other one;
    those not seen to be shared are frequent.
    """

    def side(name: str) -> DataFrame:
        marks = crowded.groupBy("class").agg(
            *[F.max(F.when(F.col("own") == flag, F.col("n_frequent"))).alias(f"frequent_{w}") for flag, w in ((True, "own"), (False, "below"))]
        )
        known = classes.select("class", "n_shingles", *SHAPE, *BITS).join(marks, "class", "left")
        return known.select(F.col("class").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in known.columns if c != "class"])

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    a, b = F.col("x_n_shingles"), F.col("y_n_shingles")
    difference = F.floor((100 - rule.percent) * (a + b) / (100 + rule.percent))
    near = _close("x", "y", rule)
    band = F.least("x_band", "y_band")
    for name in ("x", "y"):
        own = F.col(f"{name}_band") == band
        lanes = F.when(own, F.col(f"{name}_lanes_own")).otherwise(F.col(f"{name}_lanes_below"))
        frequent = F.when(own, F.col(f"{name}_frequent_own")).otherwise(F.col(f"{name}_frequent_below"))
        near = near & (F.col("n_shared") + F.coalesce(frequent, F.lit(0)) >= lanes - difference)
    return both.where(near).select("x", "y")


def _sets(wanted: DataFrame, documents: DataFrame, classes: DataFrame, text: str, row: Column, rule: Similarity) -> DataFrame:
    """(class, shingles) of the wanted classes, written once."""
    keys = staged(wanted.join(classes, "class").select("class", F.col("row").alias("key")), "jaccard_wanted")
    if keys.count() <= rule.broadcast_rows:
        keys = F.broadcast(keys)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def shingles(texts: pa.Array) -> pa.Array:
        parts = []
        for piece in pieces(texts, SMALL_PIECE):
            sets = shingle_sets(piece, rule.width)
            parts.append(pa.ListArray.from_arrays(pa.array(sets.bounds.astype(np.int32)), pa.array(sets.values.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    texts = documents.select(row.alias("key"), F.col(text).alias("text")).join(keys, "key")
    return staged(texts.dropDuplicates(["class"]).select("class", shingles("text").alias("shingles")), "jaccard_sets")


def _linked(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """Of the pairs of classes (x, y), those whose whole sets reach the similarity."""
    both = (
        pairs.join(sets.select(F.col("class").alias("x"), F.col("shingles").alias("xs")), "x")
        .join(sets.select(F.col("class").alias("y"), F.col("shingles").alias("ys")), "y")
        .select("x", "y", F.size("xs").alias("a"), F.size("ys").alias("b"), F.size(F.array_intersect("xs", "ys")).alias("common"))
    )
    union = F.col("a") + F.col("b") - F.col("common")
    return staged(both.where(100 * F.col("common").cast("long") >= rule.percent * union).select("x", "y"), "jaccard_links")


def _verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, text: str, row: Column, rule: Similarity) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    return _linked(pairs, _sets(wanted, documents, classes, text, row, rule), rule)


def _candidates(lanes: Lanes) -> DataFrame:
    """(x, y, n_shared): pairs with the ordinary lanes they share, and in frequent lanes each set with the smallest."""
    left = lanes.few.select("sig", F.col("class").alias("x"))
    pairs = left.join(lanes.few.select("sig", F.col("class").alias("y")), "sig").where("x < y")
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_shared"))
    hubs = lanes.many.groupBy("sig").agg(F.min("class").alias("x"))
    spokes = lanes.many.join(hubs, "sig").where("class != x").select("x", F.col("class").alias("y")).distinct()
    return pairs.unionByName(spokes.withColumn("n_shared", F.lit(0).cast("long"))).groupBy("x", "y").agg(F.sum("n_shared").alias("n_shared"))


def _close(x: str, y: str, rule: Similarity) -> Column:
    """Whether sizes and bit sketches of two rows allow the similarity."""
    a, b = F.col(f"{x}_n_shingles"), F.col(f"{y}_n_shingles")
    flips = sum((F.bit_count(F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))) for c in BITS), F.lit(0))
    return (flips <= F.floor((100 - rule.percent) * (a + b) / (100 + rule.percent))) & (
        100 * F.least(a, b) >= rule.percent * F.greatest(a, b)
    )


def _remaining(lanes: Lanes, labels: DataFrame) -> DataFrame:
    """(class, component) of the sets that share a frequent lane with a set of another component."""
    many = lanes.many.join(labels, F.col("class") == F.col("node"), "left")
    many = many.select("sig", "class", F.coalesce("component", "class").alias("component"))
    split = many.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("class").alias("hub"))
    apart = many.join(split.where("low < high").select("sig", "hub"), "sig").where("class != hub")
    return staged(apart.select("class", "component").distinct(), "jaccard_split")


def _by_rarest(remaining: DataFrame, sets: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs (x, y) of different components that share a shingle early enough among their rarest.

    A shingle of many sets is dealt to several tasks.
    """
    described = remaining.join(classes.select("class", "n_shingles", *BITS), "class")
    held = sets.join(remaining.select("class"), "class", "left_semi").select("class", F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    shared = held.join(counts, "shingle").join(described.select("class", "n_shingles"), "class")
    own = Window.partitionBy("class")  # the shingles of one set
    # Shingles that no other set has come first; their order does not matter.
    alone = F.col("n_shingles") - F.count(F.lit(1)).over(own)
    place = alone + F.row_number().over(own.orderBy("holders", "shingle")) - 1
    early = shared.select("class", "shingle", "holders", "n_shingles", place.alias("place"))
    early = early.where(F.col("place") <= F.floor((100 - rule.percent) * F.col("n_shingles") / 100)).drop("n_shingles")
    early = staged(early.join(described, "class"), "jaccard_rarest")
    parts = F.ceil(F.col("holders") / rule.dealt).cast("int")

    def side(name: str) -> list[Column]:
        return [F.col("class").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("place", "component", "n_shingles", *BITS)]]

    x = early.select("shingle", F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"), *side("x"))
    y = early.select("shingle", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *side("y"))
    a, b = F.col("x_n_shingles"), F.col("y_n_shingles")
    behind = F.least(a - F.col("x_place"), b - F.col("y_place"))
    enough = (100 + rule.percent) * behind >= rule.percent * (a + b)
    apart = (F.col("x") < F.col("y")) & (F.col("x_component") != F.col("y_component"))
    same = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.part") == F.col("r.part"))
    return x.alias("l").join(y.alias("r"), same & apart & enough & _close("x", "y", rule)).select("x", "y").distinct()


def _row(doc_id: str, text: str) -> Column:
    """Names a row; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Similarity = Similarity()
) -> DataFrame:
    """One row per document: (doc_id, row, n_shingles, component, component_id).

    ``row`` is a hash of id and text, ``component`` names the group and is null
    for a text without words.
    """
    row = _row(doc_id, text)
    described = documents.select(F.col(doc_id).alias("doc"), row.alias("row"), _described(rule)(F.col(text)).alias("set"))
    described = staged(described.select("doc", "row", "set.*"), "jaccard_documents")
    classes = staged(
        described.where("class IS NOT NULL")
        .groupBy("class")
        .agg(*[F.min(c).alias(c) for c in ("doc", "row", "n_shingles", *SHAPE, *BITS)]),
        "jaccard_classes",
    )
    lanes = _lanes_to_join(_signatures(documents.select(text), rule), classes, rule)
    pairs = staged(_plausible(_candidates(lanes), classes, lanes.crowded, rule), "jaccard_pairs")
    links = _verified(pairs, documents, classes, text, row, rule)
    labels = components(links)
    remaining = _remaining(lanes, labels)
    if not remaining.isEmpty():
        sets = _sets(remaining.select("class"), documents, classes, text, row, rule)
        rest = staged(_by_rarest(remaining, sets, classes, rule).join(pairs, ["x", "y"], "left_anti"), "jaccard_pairs")
        links = links.unionByName(_linked(rest, sets, rule))
        labels = components(links)
    linked = labels.join(classes.select(F.col("class").alias("node"), "doc"), "node")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("first_doc"))
    named = linked.join(smallest, "component").select(F.col("node").alias("class"), "component", "first_doc")
    groups = classes.select("class", "doc").join(named, "class", "left")
    groups = groups.select(
        "class",
        F.coalesce("component", "class").alias("component"),
        F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("first_doc")).alias("component_id"),
    )
    alone = F.when(F.col("class").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return described.join(groups, "class", "left").select(
        F.col("doc").alias("doc_id"), "row", "n_shingles", "component", alone.alias("component_id")
    )


def one_of_each(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Similarity = Similarity()
) -> DataFrame:
    """The documents without those that a group has besides its smallest id; texts without words stay.

    Of equal rows one stays.  The documents' columns are what they were.
    """
    found = staged(near_duplicates(documents, doc_id, text, rule).where("component IS NOT NULL"), "jaccard_found")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("kept"))
    lost = found.join(first, "component").where("row != kept").select("row").distinct()
    again = found.groupBy("row").count().where("count > 1").select("row")
    key = unused(documents, "_row")
    marks = lost.withColumn(f"{key}_lost", F.lit(True)).unionByName(
        again.join(lost, "row", "left_anti").withColumn(f"{key}_lost", F.lit(False))
    )
    marks = staged(marks.withColumnRenamed("row", f"{key}_mark"), "jaccard_marks")
    if marks.count() <= rule.broadcast_rows:
        marks = F.broadcast(marks)
    keyed = documents.withColumn(key, _row(doc_id, text))
    keyed = keyed.join(marks, F.col(key) == F.col(f"{key}_mark"), "left")
    single = keyed.where(F.col(f"{key}_lost").isNull())
    repeated = keyed.where(~F.col(f"{key}_lost")).dropDuplicates([key])
    return single.unionByName(repeated).drop(key, f"{key}_mark", f"{key}_lost")
