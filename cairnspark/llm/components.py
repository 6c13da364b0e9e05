"""Connected components of an edge table by alternating star operations; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


#: Edges in one task, where tasks can be put together.
TASK_EDGES = 100_000


def stars(rows: DataFrame, kind: str, changed=None, emitted=None) -> DataFrame:
    """Edges (a, b) of stars over rows(u, v) that are partitioned by u and sorted by u, v; one pass, constant memory.

    ``siblings``: from the least v of each u to its other v.
    ``small``: the same for v < u, and from the least v to u itself.
    ``large``: from the least of u and its neighbours v to every neighbour above u.
    Repeats of a row count once.  ``changed`` is an accumulator that is raised where an edge isn't there already,
    ``emitted`` one that counts edges.
    """
    node = rows.schema["v"].dataType.simpleString()

    def run(batches):
        last_u = last_v = first = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            u, v = batch.column(0), batch.column(1)
            new, same = np.ones(n, bool), np.zeros(n, bool)
            new[1:] = pc.not_equal(u.slice(1), u.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same[1:] = pc.equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False) & ~new[1:]
            if last_u is not None and u[0].as_py() == last_u:
                new[0], same[0] = False, v[0].as_py() == last_v
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1)) + 1
            hub = pa.concat_arrays([pa.array([first], v.type), v]).take(pa.array(start))
            last_u, last_v, first = u[n - 1].as_py(), v[n - 1].as_py(), hub[n - 1].as_py()
            if kind == "large":
                keep = pc.greater(v, u).to_numpy(zero_copy_only=False) & ~same
                hub = pc.if_else(pc.less(hub, u), hub, u)
                edges, moved = [(hub, v, keep)], keep & pc.not_equal(hub, u).to_numpy(zero_copy_only=False)
            else:
                moved = ~new & ~same & pc.not_equal(hub, v).to_numpy(zero_copy_only=False)
                edges = [(hub, v, moved)]
                if kind == "small":
                    edges.append((hub, u, new))
            if changed is not None and moved.any():
                changed.add(1)
            for a, b, keep in edges:
                if keep.any():
                    mask = pa.array(keep)
                    if emitted is not None:
                        emitted.add(int(keep.sum()))
                    yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return rows.mapInArrow(run, f"a {node}, b {node}")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("u").sortWithinPartitions("u", "v")


def hot_keys(rows: DataFrame, one_in: int = 16, least: int = 24, most: int = 1000) -> list[tuple]:
    """The u with the most rows in a sample by hash of v, ``most`` at the most; and whether those with v < u are many.

    The choice decides where rows go, not what comes out.
    """
    counts = [F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("lesser")]
    sample = rows.where(F.pmod(F.xxhash64("v"), F.lit(one_in)) == 0).groupBy("u").agg(*counts).where(F.col("n") >= least)
    return [(plain(r["u"]), r["lesser"] >= least) for r in sample.orderBy(F.desc("n"), "u").limit(most).collect()]


def plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def starred(rows: DataFrame, kind: str, hot: list, changed=None, emitted=None) -> DataFrame:
    """The same edges as ``stars(grouped(rows), kind)``, with no task that reads all rows of a ``hot`` u.

    All that a u needs is the least of its v.  For a hot one that is combined on the map side; its rows then stay
    where they are and meet that least v there.  What goes to the tasks has a value for each key in ``hot``.
    """
    if not hot:
        return stars(grouped(rows), kind, changed, emitted)
    is_hot, node = F.col("u").isin(hot), rows.schema["v"].dataType.simpleString()
    ends = rows.where(is_hot).groupBy("u").agg(F.min("v").alias("first"), F.max("v").alias("last")).collect()
    if changed is not None and any(r["first"] < r["u"] < r["last"] if kind == "large" else r["first"] != r["last"] for r in ends):
        changed.add(1)
    keys, firsts = [plain(r["u"]) for r in ends], [plain(r["first"]) for r in ends]

    def run(batches):
        kept_keys = kept_firsts = None
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            if kept_keys is None:
                kept_keys, kept_firsts = pa.array(keys, u.type), pa.array(firsts, v.type)
            first = kept_firsts.take(pc.index_in(u, value_set=kept_keys))
            if kind == "large":
                mask, first = pc.greater(v, u), pc.if_else(pc.less(first, u), first, u)
            else:
                mask = pc.not_equal(v, first)
            yield pa.RecordBatch.from_arrays([first.filter(mask), v.filter(mask)], ["a", "b"])

    out = rows.where(is_hot).select("u", "v").mapInArrow(run, f"a {node}, b {node}")
    if kind != "large":  # there rows of different u seldom give the same edge
        out = out.distinct()
    if kind == "small":
        out = out.unionByName(rows.sparkSession.createDataFrame(list(zip(firsts, keys, strict=True)), f"a {node}, b {node}"))
    return stars(grouped(rows.where(~is_hot)), kind, changed, emitted).unionByName(out)


def connected_components(edges: DataFrame, most_rounds: int = 60, **sizes: int) -> DataFrame:
    """node and root for every node of ``edges`` (columns a, b) but the roots; a root is the least node of its component.

    Large-star and small-star operations in turn: the first ties a node's greater neighbours to its least one, the
    second its lesser ones; what stays the same in a round is one star for each component.  A round is two shuffles
    of (node, node) rows, each reduced as a stream; rows of hot nodes are not shuffled (see ``starred``).  The second
    operation has for a node no more rows than it has lesser neighbours in the first, so hot ones are known before.
    """
    edges, known = edges.where("a <> b"), edges.count()
    context = edges.sparkSession.sparkContext
    for _ in range(most_rounds):
        changed, emitted = context.accumulator(0), context.accumulator(0)
        edges = edges.coalesce(max(context.defaultParallelism, known // TASK_EDGES + 1))  # small graphs make no crowd of tasks
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        hot = hot_keys(both, **sizes)
        large, hot = starred(both, "large", [u for u, _ in hot], changed), [u for u, lesser in hot if lesser]
        if hot:
            large = durable(large)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = durable(starred(down, "small", hot, changed, emitted))
        known = emitted.value
        if changed.value == 0:  # a task that ran twice can only raise it
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"no end after {most_rounds} rounds")
