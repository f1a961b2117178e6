"""Merkle dataset manifest: time-forward processing over node labels.

A document's leaf is the SHA-256 of its fields.  The leaves of a group (source),
ordered by document, are hashed together in runs of ``FAN``, the runs' digests
again, until one node is left; the groups' nodes in order likewise give the root.

*Forward.*  A node's label is (the last leaf below it, its level): in that order
every node comes after its children.  A sweep goes through the nodes in order and
sends each digest to the parent's label in a priority queue; when the sweep has
passed a label's last leaf, all its messages have arrived and lie on top of the
queue.  The queue is external: a task keeps the labels of its own chunk of
``FAN ** LEVELS`` nodes, at most a few runs at a time, and what goes to higher
labels leaves it as rows, which a shuffle sorted by label delivers to the next
sweep.  A tree of n leaves takes log(n) / log(chunk) sweeps, the next one over
as many rows as there were chunks.

*Backward.*  The same labels in reverse order hand each node the rest of its
proof, the siblings from its parent up to the root; a chunk gets one such message
and passes it on, with a step more, to its own nodes.  Only at the leaves are
proofs as long as the tree is high: there they are hashed and folded at once.

Positions come from a range-partitioned sort, so a group that holds a third of
all rows is spread like the rest; no group is ever in one task.

Defined results: a null field is ``-``, else its bytes' number, a colon and the
bytes; a null group is a group of its own, before all others; a null id comes
first; of equal ids the smaller leaf comes first; repeated rows are rows; one
leaf alone is its group's node, one group alone the root; a leaf without
siblings has the digest of nothing as its proof; an empty table has no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.hot import attached
from cartledger.llm.session import staged
from cartledger.operators.ranking import row_index
from cartledger.staging import StageArea

FAN = 16
LEVELS = 2  # levels of a chunk, that is of one sweep
CHUNK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64  # characters


# -- inside tasks


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _widths(n: int) -> list[int]:
    """Nodes per level of a chunk's sweep over a level of n nodes, that one included."""
    widths = [n]
    while len(widths) <= LEVELS and widths[-1] > 1:
        widths.append(-(-widths[-1] // FAN))
    return widths


@dataclass
class Sweep:
    """A forward sweep over one chunk's nodes, and the record that its reverse follows."""

    n: int  # nodes of the whole level
    digests: dict[tuple[int, int], str] = field(default_factory=dict)  # (level, index)
    order: list[tuple[int, int]] = field(default_factory=list)  # inner nodes as they were made

    def forward(self, first: int, nodes: Sequence[str]) -> tuple[int, str]:
        """Take in the chunk's nodes; gives (index, digest) of the node that stands for it."""
        widths, queue = _widths(self.n), []

        def send(level: int, index: int, digest: str) -> None:
            self.digests[level, index] = digest
            if level + 1 < len(widths):
                parent = index // FAN
                last = min((parent + 1) * FAN ** (level + 1), self.n) - 1
                heappush(queue, (last, level + 1, parent, index, digest))

        for at, digest in enumerate(nodes, first):
            send(0, at, digest)
            while queue and queue[0][0] <= at:
                label, arrived = queue[0][:3], []
                while queue and queue[0][:3] == label:
                    arrived.append(heappop(queue)[4])
                self.order.append(label[1:])
                send(label[1], label[2], _h("".join(arrived)))
        top = len(widths) - 1
        index = first // FAN**top
        return index, self.digests[top, index]

    def backward(self, first: int, count: int, above: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
        """The proof of each node of the chunk, given that of the node that stands for it."""
        widths = _widths(self.n)
        top = len(widths) - 1
        known = {(top, first // FAN**top): above}
        for level, index in reversed(self.order):
            rest = known.pop((level, index))
            run = range(index * FAN, min((index + 1) * FAN, widths[level - 1]))
            texts = [self.digests[level - 1, i] for i in run]
            for slot, i in enumerate(run):
                known[level - 1, i] = [(slot, "".join(texts[:slot] + texts[slot + 1 :])), *rest]
        return (known[0, at] for at in range(first, first + count))


def folded(digest: str, proof: list[tuple[int, str]]) -> str:
    """The root that a leaf and its proof, steps of (place in the run, siblings), lead to."""
    for slot, siblings in proof:
        at = slot * DIGEST
        digest = _h(siblings[:at] + digest + siblings[at:])
    return digest


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by (tree, chunk), a chunk at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["chunk"]) != (held[0]["tree"], held[0]["chunk"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ROWS_OUT = 4096
_STEPS = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())]))
STEPS = "array<struct<slot: int, siblings: string>>"
_NODE = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_MESSAGE = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("subroot", pa.string()), ("proof", _STEPS)])
_LEAF = pa.schema(
    [("id", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()),
     ("folded_root", pa.string()), ("proof", _STEPS)]
)


def _raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in _chunks(batches):
        n = rows[0]["n"]
        index, digest = Sweep(n).forward(rows[0]["pos"], [r["digest"] for r in rows])
        out.append((rows[0]["tree"], index, _widths(n)[-1], digest))
        if len(out) >= _ROWS_OUT:
            yield _batch(out, _NODE)
            out = []
    yield _batch(out, _NODE)


def _told(rows: list[dict]) -> Iterator[tuple[dict, str, list[tuple[int, str]]]]:
    """(node, subroot, proof) of a chunk's nodes; its first row is the message from above."""
    message, nodes = rows[0], rows[1:]
    sweep, first = Sweep(nodes[0]["n"]), nodes[0]["pos"]
    sweep.forward(first, [r["digest"] for r in nodes])
    above = [(s["slot"], s["siblings"]) for s in message["proof"]]
    for node, proof in zip(nodes, sweep.backward(first, len(nodes), above)):
        yield node, message["subroot"], proof


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        yield _batch([(r["tree"], r["pos"], subroot, _steps(proof)) for r, subroot, proof in _told(rows)], _MESSAGE)


def _steps(proof: list[tuple[int, str]]) -> list[dict]:
    return [{"slot": slot, "siblings": siblings} for slot, siblings in proof]


def _proven(with_proofs: bool):
    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            out = []
            for r, subroot, proof in _told(rows):
                digest = _h("".join(siblings for _, siblings in proof))
                steps = _steps(proof) if with_proofs else None
                out.append((r["id"], r["digest"], subroot, digest, folded(r["claimed"], proof), steps))
            yield _batch(out, _LEAF)

    return proven


# -- on Spark


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a document's fields."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]).cast("binary"), 256)


def _by_chunk(nodes: DataFrame) -> DataFrame:
    """Nodes (and messages for chunks, which have no position) dealt and sorted by label."""
    return nodes.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", F.col("pos").asc_nulls_first())


def _forward(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes (tree, pos, n, digest) of each sweep, until every tree has one node."""
    sweeps = [nodes]
    while most > 1:
        below = sweeps[-1].select("tree", "pos", "n", "digest", F.expr(f"pos div {CHUNK}").alias("chunk"))
        raised = _by_chunk(below).mapInArrow(_raised, "tree long, pos long, n long, digest string")
        sweeps.append(staged(raised, "merkle_nodes"))
        most = _widths(most)[-1]
    return sweeps


def _labelled(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    own = nodes.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    told = messages.withColumnRenamed("pos", "chunk")
    return _by_chunk(own.unionByName(told, allowMissingColumns=True))


def _backward(sweeps: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Proofs (tree, pos, subroot, proof) of the first sweep's nodes, given those of the last one's."""
    for nodes in reversed(sweeps[:-1]):
        lowered = _labelled(nodes.select("tree", "pos", "n", "digest"), messages)
        messages = staged(lowered.mapInArrow(_lowered, f"tree long, pos long, subroot string, proof {STEPS}"), "merkle_proofs")
    return messages


@dataclass
class Manifest:
    leaves: DataFrame  # the id, leaf, subroot, proof_sha256, folded_root, and proof if asked for
    root: str | None


def manifest(
    documents: DataFrame,
    suspect: Column | None = None,
    claimed: dict[str, Column] | None = None,
    with_proofs: bool = False,
    fields: Sequence[str] = FIELDS,
    doc_id: str = "doc_id",
    group: str = "source",
) -> Manifest:
    """The manifest of the documents, and for every row the root its proof leads to.

    Where ``suspect`` holds, that root is folded from the fields in ``claimed``
    instead of the documents' own.
    """
    spark, stage = documents.sparkSession, StageArea.of(documents.sparkSession)
    own = leaf([F.col(f) for f in fields])
    other = leaf([(claimed or {}).get(f, F.col(f)) for f in fields])
    leaves = documents.select(
        F.col(doc_id).alias("id"),
        F.col(group).alias("group"),
        own.alias("digest"),
        (F.when(suspect, other) if suspect is not None else F.lit(None).cast("string")).alias("other"),
    )
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("other").asc_nulls_first()]
    placed = row_index(staged(leaves, "merkle_leaves"), order, stage, "row")
    groups = staged(placed.groupBy("group").agg(F.min("row").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle_groups")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    nodes = attached(placed, groups, "group").select(
        F.col("id").cast("string").alias("id"),
        "tree",
        (F.col("row") - F.col("tree")).alias("pos"),
        "n",
        "digest",
        F.coalesce("other", "digest").alias("claimed"),
    )
    sweeps = _forward(staged(nodes, "merkle_placed"), most or 0)

    tops = row_index(staged(sweeps[-1].select("tree", "digest"), "merkle_tops"), [F.col("tree").asc()], stage, "pos")
    tops = tops.select(F.col("tree").alias("below"), F.lit(0).cast("long").alias("tree"), "pos", F.lit(n_groups).cast("long").alias("n"), "digest")
    upper = _forward(staged(tops, "merkle_upper"), n_groups)
    last = upper[-1].select("digest").first()
    root = last[0] if last else None

    apex = spark.createDataFrame([(0, 0, root, [])] if last else [], f"tree long, pos long, subroot string, proof {STEPS}")
    told = _backward(upper, apex).select("pos", "proof")
    told = upper[0].join(told, "pos").select(
        F.col("below").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "proof"
    )
    told = _backward(sweeps[1:], told)
    schema = f"id string, leaf string, subroot string, proof_sha256 string, folded_root string, proof {STEPS}"
    found = _labelled(sweeps[0], told).mapInArrow(_proven(with_proofs), schema)
    kept = ["leaf", "subroot", "proof_sha256", "folded_root", *(["proof"] if with_proofs else [])]
    return Manifest(found.select(F.col("id").cast(documents.schema[doc_id].dataType).alias(doc_id), *kept), root)
