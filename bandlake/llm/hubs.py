"""Linking things that share keys without comparing all pairs of a key.

A key's members are compared with a few hubs; what links joins a component, and only members of different components are compared
further, until every two members of a key are in one component or were compared, or ruled out by ``fits`` and ``room``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .components import merge_labels

Test = Callable[[str, str], Column]


def _apart(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The rows, with component, of keys whose members are in more than one component."""
    held = rows.join(labels.withColumnRenamed("node", "sig"), "sig")
    keys = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return settle(held.join(keys, "key"), f"{label}-held")


def first_pairs(members: DataFrame, fits: Test | None = None, least: int = 1) -> DataFrame:
    """Distinct pairs (a, b: sig), one for each member that has a partner: of the most connected members of its keys, the one it shares
    most keys with, ``least`` at least. ``members`` has key, sig and own columns, each key and sig once.
    """
    if "score" not in members.columns:
        members = members.join(members.groupBy("sig").agg(F.count("*").alias("score")), "sig")
    as_one = F.struct("score", *[c for c in members.columns if c not in ("score", "key")])
    top = members.groupBy("key").agg(F.max(as_one).alias("h"))
    near = members.alias("m").join(top.select(F.col("key").alias("hub_key"), "h.*").alias("h"), F.col("m.key") == F.col("hub_key")).where(F.col("m.sig") != F.col("h.sig"))
    if fits is not None:
        near = near.where(fits("m", "h"))
    best = near.groupBy(F.col("m.sig").alias("sig"), F.col("h.sig").alias("hub")).count().where(F.col("count") >= least).groupBy("sig").agg(F.max(F.struct("count", "hub")).alias("best"))
    return best.select(F.least("sig", "best.hub").alias("a"), F.greatest("sig", "best.hub").alias("b")).distinct()


def link_by_hubs(members: DataFrame, verify: Callable[[DataFrame], DataFrame], *, fits: Test | None = None, room: Test | None = None, more: Callable[[DataFrame], DataFrame] | None = None, hubs: int = 2, growth: int = 8, label: str = "hubs") -> DataFrame:
    """Labels (node, component) of the members (key, sig and own columns).

    ``verify`` takes pairs (a, b: sig) and returns those that link. ``fits`` and ``room`` are conditions on the column prefixes of a member and a hub
    that any link meets; ``room`` may use the columns by sig that ``more`` returns for the members left after the first round.

    First each member is compared with one other: of the most connected members of its keys, the one it shares most keys with. Then, round by
    round, the foremost ``hubs`` members of each key that is still in several components are compared with the members of its other
    components; hubs that were compared leave their keys, and ``hubs`` grows.
    """
    score = members.groupBy("sig").agg(F.count("*").alias("score"))
    left = settle(members.join(score, "sig"), f"{label}-left")
    labels = settle(left.select(F.col("sig").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    test = lambda *tests: [t("m", "h") for t in tests if t is not None]
    done = settle(first_pairs(left, fits), f"{label}-pairs")
    labels = merge_labels(labels, verify(done))
    left = _apart(left, labels, label).drop("component")
    if more is not None:
        left = settle(left.join(more(left), "sig"), f"{label}-left")
    while True:
        held = _apart(left, labels, label)
        if held.isEmpty():
            return labels
        sizes = settle(labels.groupBy("component").agg(F.count("*").alias("weight")), f"{label}-sizes")
        order = Window.partitionBy("key").orderBy(F.desc("weight"), F.desc("score"), "sig")
        hub = settle(held.join(sizes, "component").withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs).drop("place", "weight", "score"), f"{label}-hubs")
        met = (F.col("m.key") == F.col("h.key")) & (F.col("m.component") != F.col("h.component"))
        for condition in test(fits, room):
            met = met & condition
        pairs = held.alias("m").join(hub.alias("h"), met).select(F.least("m.sig", "h.sig").alias("a"), F.greatest("m.sig", "h.sig").alias("b")).distinct()
        pairs = settle(pairs.join(done, ["a", "b"], "left_anti"), f"{label}-pairs")
        if not pairs.isEmpty():
            labels = merge_labels(labels, verify(pairs))
        left = held.join(hub.select("key", "sig"), ["key", "sig"], "left_anti").drop("component")
        done = done.union(pairs)
        hubs *= growth
