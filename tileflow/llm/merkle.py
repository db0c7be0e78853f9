"""Merkle manifest of a table: one digest for each row, part and table, and for each row the proof that it belongs.

Leaves are numbered by a parallel range sort and packed into aligned blocks of ``fanout ** block_levels`` leaves, in
which all lower nodes are computed. The upper levels are a butterfly: in round r the blocks of one parent that hold the
same place below it, at most ``fanout`` of them, swap the digests of their nodes, and every block hashes the parent for
itself. So each block gains the siblings of its whole path on the way up, and nothing has to be sent down again. The
last node of a level may hold fewer blocks than its siblings; its blocks then answer for several places. DataFrame
expressions only; a group of a round never holds more than ``fanout`` digests, and no table meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.llm.folders import prepare, stored
from tileflow.operators.numbering import dense_row_id

_PROOF = "array<struct<before: string, after: string>>"


def record_digest(fields: Sequence[Column]) -> Column:
    """sha256 (lowercase hex) of the fields one after the other: ``-`` for null, else byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    shown = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in shown]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level and left to right, in one string."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def _step(run: Column, own: Column, fanout: int) -> Column:
    """Siblings before and after the place ``own`` (from 0) of a run of digests."""
    before, after = F.slice(run, F.lit(1), own), F.slice(run, own + 2, F.lit(fanout))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def _parents(level: Column, fanout: int) -> Column:
    firsts = F.sequence(F.lit(1), F.size(level), F.lit(fanout))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(level, i, F.lit(fanout)), ""), 256))


def butterfly(nodes: DataFrame, fanout: int = 8) -> DataFrame:
    """Adds ``root`` and ``proof`` to nodes (group, index, n, digest): those numbered 0 to n - 1 in each group.

    Every round is one shuffle of the nodes; the largest group sets the number of rounds. A group of one node has
    its digest as root and an empty proof.
    """
    state = nodes.select("group", "index", "n", "digest", F.lit(None).cast(_PROOF).alias("proof"))
    state = state.withColumn("proof", F.coalesce("proof", F.array().cast(_PROOF)))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    width = 1  # nodes below a node of this round's level, where it is full
    while width < largest:
        state = stored(_exchange(state, width, fanout), "round")
        width *= fanout
    return state.withColumnRenamed("digest", "root")


def _exchange(state: DataFrame, width: int, fanout: int) -> DataFrame:
    node = F.expr(f"index div {width}")
    last = F.expr(f"(n - 1) div {width}")  # the last node of this level; with number 0 the group is done
    place, child = F.col("index") % width, node % fanout
    held = F.col("n") - node * width  # places the last node has
    places = F.when((node == last) & (child > 0), F.sequence(place, F.lit(width - 1).cast("bigint"), held))
    sent = state.where(last > 0).select(
        "group",
        F.expr(f"index div {width * fanout}").alias("parent"),
        F.explode(F.coalesce(places, F.array(place))).alias("place"),
        child.alias("child"),
        "digest",
        F.struct("index", "n", "proof", child.alias("child"), place.alias("place")).alias("own"),
    )
    own = F.when(F.col("own.place") == F.col("place"), F.col("own"))  # otherwise it only answers for another place
    met = sent.groupBy("group", "parent", "place").agg(
        F.sort_array(F.collect_list(F.struct("child", "digest"))).alias("run"), F.collect_list(own).alias("owns")
    )
    met = met.select("group", F.col("run.digest").alias("run"), F.explode("owns").alias("own"))
    step = _step(F.col("run"), F.col("own.child").cast("int"), fanout)
    up = met.select(
        "group",
        "own.index",
        "own.n",
        F.sha2(F.array_join("run", ""), 256).alias("digest"),
        F.concat("own.proof", F.array(step)).alias("proof"),
    )
    return up.unionByName(state.where(last == 0))


def merkle_proofs(
    leaves: DataFrame,
    id_col: str = "doc_id",
    part_col: str = "lang",
    leaf_col: str = "leaf",
    fanout: int = 8,
    block_levels: int = 4,
) -> DataFrame:
    """``leaves`` with ``subroot`` of its part, ``root`` and ``proof``, an array of (before, after) from the leaf up.

    In each part the leaves ascend by id; while several nodes remain, every ``fanout`` consecutive ones (the last run
    may have fewer) become the sha256 of their digests. The subroots, by part, give the root likewise. ``fold`` and
    ``siblings`` use a proof. ``block_levels`` changes the work, not the result: a block is one row of the packed
    table. The other columns travel with the leaves, so leave texts out.

    Defined cases: a null part comes first; null ids come first in their part; rows of one id go by their digest, so
    that reruns agree, and repeated rows are leaves of their own; an empty table gives an empty result; a text of any
    length is one digest by then; columns called like an added one are replaced.
    """
    prepare(leaves.sparkSession)
    leaves = leaves.drop("subroot", "root", "proof")
    row = F.struct(*leaves.columns).alias("row")
    keys = F.col(part_col).alias("part"), F.col(id_col).alias("id"), F.col(leaf_col).alias("leaf"), row
    order = [F.asc_nulls_first(c) for c in ("part", "id", "leaf")]
    numbered = stored(dense_row_id(stored(leaves.select(*keys), "leaves"), order, "at"), "numbered")
    parts = numbered.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_leaves"))
    parts = stored(dense_row_id(parts, ["first"], "group"), "parts").withColumnRenamed("part", "name")

    size = fanout**block_levels
    at = F.col("at") - F.col("first")
    placed = numbered.join(parts, F.col("part").eqNullSafe(F.col("name")))
    placed = placed.select("group", F.floor(at / size).alias("index"), "n_leaves", "at", "leaf", "row")
    packed = placed.groupBy("group", "index", F.ceil(F.col("n_leaves") / size).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("at", "leaf", "row"))).alias("held")  # at most a block
    )
    packed = packed.select("group", "index", "n", F.col("held.row").alias("held"), F.col("held.leaf").alias("level0"))
    digest = F.col("level0")
    for k in range(1, block_levels + 1):  # a part of one block stops when one node is left
        below = F.col(f"level{k - 1}")
        more = (F.col("n") > 1) | (F.size(below) > 1)
        packed = packed.withColumn(f"level{k}", F.when(more, _parents(below, fanout)))
        digest = F.coalesce(F.col(f"level{k}"), digest)
    packed = stored(packed.withColumn("digest", digest[0]), "blocks")

    paths = butterfly(packed.select("group", "index", "n", "digest"), fanout)
    heads = paths.where("index = 0").select("group", F.col("root").alias("digest"))
    number = heads.count()
    tops = butterfly(
        heads.select(F.lit(0).alias("group"), F.col("group").alias("index"), F.lit(number).cast("bigint").alias("n"), "digest"),
        fanout,
    ).select(F.col("index").alias("group"), "root", F.col("proof").alias("top"))
    paths = paths.withColumnRenamed("root", "subroot").join(tops, "group")
    paths = paths.select("group", "index", "subroot", "root", F.concat("proof", "top").alias("upper"))

    def proven(held: Column, i: Column) -> Column:
        steps = []
        for k in range(block_levels):
            node, level = F.floor(i / fanout**k).cast("int"), F.col(f"level{k}")
            run = F.slice(level, (F.floor(node / fanout) * fanout + 1).cast("int"), F.lit(fanout))
            steps.append(F.when(F.col(f"level{k + 1}").isNotNull(), _step(run, node % fanout, fanout)))
        local = F.filter(F.array(*steps), lambda s: s.isNotNull())
        return F.struct(held.alias("row"), F.concat(local, F.col("upper")).alias("proof"))

    out = packed.join(paths, ["group", "index"]).select(
        F.explode(F.transform("held", proven)).alias("x"), "subroot", "root"
    )
    return out.select("x.row.*", "subroot", "root", "x.proof")
