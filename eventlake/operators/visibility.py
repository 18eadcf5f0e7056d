"""Replication by visibility: which site may see which entity, what to send, and safe application at the replica."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import unused
from .log import contiguous_prefix

EVERYONE = "*"


def sees(sites: Column, site: str) -> Column:
    return F.array_contains(sites, site) | F.array_contains(sites, EVERYONE)


def classify(log: DataFrame, sites: Column, local: str) -> DataFrame:
    """(persistence_id, master, sites): an entity is mastered where its first event's first site says; its sites are all ever named."""
    (own,) = unused(log, "_sites")
    named = log.withColumn(own, sites)
    first = F.min_by(own, F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, F.col("sequence_nr")))
    seen = named.groupBy("persistence_id").agg(F.coalesce(F.get(first, F.lit(0)) == local, F.lit(False)).alias("master"))
    each = named.select("persistence_id", F.explode(own).alias("site")).distinct()
    sets = each.groupBy("persistence_id").agg(F.array_sort(F.collect_set("site")).alias("sites"))
    return seen.join(sets, "persistence_id", "left").withColumn("sites", F.coalesce("sites", F.array().cast("array<string>")))


def with_visibility(log: DataFrame, visibility: DataFrame) -> DataFrame:
    """Every event with its entity's visibility; unknown entities are mastered nowhere and visible to none."""
    found = log.join(visibility.select("persistence_id", "master", "sites"), "persistence_id", "left")
    return found.withColumns({"master": F.coalesce("master", F.lit(False)), "sites": F.coalesce("sites", F.array().cast("array<string>"))})


def visible_to(log: DataFrame, visibility: DataFrame, site: str) -> DataFrame:
    """The events that a site may see."""
    return log.join(visibility.where(sees(F.col("sites"), site)).select("persistence_id"), "persistence_id", "left_semi")


def forward(history: DataFrame, live: DataFrame, before: DataFrame, after: DataFrame, site: str) -> DataFrame:
    """What to send to a site for a batch of new events: the whole history of entities that it may see from now on, and live events of the others it sees.

    before and after are visibility tables; history includes the live events.
    """
    seen = lambda v: v.where(sees(F.col("sites"), site)).select("persistence_id")
    new = seen(after.where("master")).join(seen(before), "persistence_id", "left_anti")
    backfill = history.join(new, "persistence_id", "left_semi")
    going_on = live.join(seen(before), "persistence_id", "left_semi")
    return backfill.unionByName(going_on).dropDuplicates(["persistence_id", "sequence_nr"])


def apply_replica(stored: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, waiting) after events arrive at a replica in any order, some again, some too early.

    The log grows by what joins it without a gap; events behind a gap wait.
    Stored events win over arriving copies.
    """
    fresh = arriving.join(stored.select("persistence_id", "sequence_nr"), ["persistence_id", "sequence_nr"], "left_anti")
    log = contiguous_prefix(stored.unionByName(fresh))
    waiting = fresh.join(log.select("persistence_id", "sequence_nr"), ["persistence_id", "sequence_nr"], "left_anti").dropDuplicates(["persistence_id", "sequence_nr"])
    return log, waiting
