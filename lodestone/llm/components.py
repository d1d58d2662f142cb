"""Connected components of an edge list by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, discard, materialize, small_side, written

#: Edges of one node that one task may take; a node with more is dealt over several.
SPLIT = 1 << 14


def _salted(df: DataFrame, hubs: DataFrame, key: str, spread: str) -> DataFrame:
    """df with the column slot: rows of a hub are dealt over its slots by a hash of `spread`, others have slot 0."""
    out = df.join(hubs, key, "left")
    return out.withColumn("slot", F.pmod(F.xxhash64(spread), F.coalesce("slots", F.lit(1)))).drop("slots")


def _repeated(df: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
    """df with one row for each slot of its key."""
    out = df.join(hubs, key, "left")
    return out.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")


def _hubs(df: DataFrame, key: str) -> DataFrame:
    """(key, slots) of the keys that have more than SPLIT rows; at most 1 / SPLIT of df's number."""
    many = df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > SPLIT)
    return small_side(materialize(many.select(key, F.ceil(F.col("rows") / SPLIT).cast("long").alias("slots"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in edges (a long, b long); root is the smallest id of its component.

    Each round takes the least label among neighbours and then the label's own label, so that rounds grow with the
    logarithm of a component's width; every round is written to the shared folder, and what it replaces is removed.
    Labels of SMALL ids at most are broadcast, so that a round has one shuffle. Else edges of a node, and nodes of a
    label, beyond SPLIT are dealt over several tasks. An edge list without rows gives none; nulls are no nodes.
    """
    # Both directions, and each node with itself: its own label is among those that it sees.
    whole = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ways = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))
    both = materialize(whole.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    few = both.where("a = b").count() <= SMALL
    hubs = None if few else _hubs(both, "b")
    split = not few and not hubs.isEmpty()
    labels, labels_at = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")))
    both = materialize(_salted(both, hubs, "b", "a")) if split else both
    for _ in range(max_rounds):
        seen = labels.withColumnRenamed("id", "b")
        met = both.join(_repeated(seen, hubs, "b"), ["b", "slot"]) if split else both.join(F.broadcast(seen) if few else seen, "b")
        own = F.when(F.col("a") == F.col("b"), F.col("root"))
        step, step_at = written(met.groupBy(F.col("a").alias("id")).agg(F.min(own).alias("was"), F.min("root").alias("root")))
        new, new_at, gone = _jumped(step, step_at, few)
        changed = not new.where(F.col("root") != F.col("was")).isEmpty()
        discard(edges.sparkSession, labels_at, *gone)  # with the round's broadcasts, which the driver holds
        labels, labels_at = new.select("id", "root"), new_at
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _jumped(step: DataFrame, step_at: str, few: bool) -> tuple[DataFrame, str, list[str]]:
    """A round's rows (id, was, root), written at step_at, with each label replaced by its own label; their path; paths that aren't needed any more."""
    if few:
        up = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        return *written(step.join(F.broadcast(up), "root").select("id", "was", F.col("up").alias("root"))), [step_at]
    # A label that has a smaller one itself: one row for each such label, whatever the number of its nodes.
    used = step.groupBy("root").agg(F.count("*").alias("rows"))
    moved = used.join(step.select(F.col("id").alias("root"), F.col("root").alias("up")), "root").where("up <> root")
    moved, moved_at = written(moved.select("root", "up", F.ceil(F.col("rows") / SPLIT).cast("long").alias("slots")))
    n, most = moved.agg(F.count("*"), F.max("slots")).first()
    if not n:
        return step, step_at, [moved_at]
    if n <= SMALL:
        new = step.join(F.broadcast(moved.select("root", "up")), "root", "left")
    elif most == 1:
        new = step.join(moved.select("root", "up"), "root", "left")
    else:
        held = _salted(step, moved.where("slots > 1").select("root", "slots"), "root", "id")
        up = moved.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).select("root", "slot", "up")
        new = held.join(up, ["root", "slot"], "left")
    return *written(new.select("id", "was", F.coalesce("up", "root").alias("root"))), [step_at, moved_at]
