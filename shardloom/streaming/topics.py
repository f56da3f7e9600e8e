"""Topics: a live line's place, and subscriptions to it."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tag
from ..registry import TableRegistry
from ..sources import line_protocol

WILDCARD = "*"


def topic_of(values: Sequence[Column], missing: str = WILDCARD) -> Column:
    """Values joined by @, with a stand-in for missing ones; exact, in the case of letters they came in."""
    return F.concat_ws("@", *(F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit(missing)) for v in values))


def topic_of_tags(tags: Column, names: Sequence[str], missing: str = WILDCARD) -> Column:
    return topic_of([tag(tags, n) for n in names], missing)


def publish(lines: DataFrame, registry: TableRegistry, names: Sequence[str] = ("symbol",), missing: str = WILDCARD, line: str = "value") -> DataFrame:
    """Lines of declared, sharded tables, parsed, with their topic; works on streams and tables alike.

    Publishing and persisting are two queries over one source: a tick may be seen before it is stored.
    """
    tables = [t.lower() for t in registry.names() if registry.is_sharded(t)]
    rows = line_protocol.parse(lines, line).where(F.lower("measurement").isin(tables))
    return rows.withColumn("topic", topic_of_tags(F.col("tags"), names, missing))


def subscribed(ticks: DataFrame, topics: Collection[str]) -> DataFrame:
    """Ticks of some topics; with `*` among them, of all.  A tick that is asked for twice comes once."""
    return ticks if WILDCARD in topics else ticks.where(F.col("topic").isin(sorted(topics)))


CONTROL = "struct<op:string,topics:array<string>,topic:string,last_n:int>"


def controls(messages: DataFrame, body: str = "value", kept: Sequence[str] = ()) -> DataFrame:
    """Control messages (op, topics, topic, last_n): subscribe, unsubscribe and replay; others are left out."""
    c = messages.select(*kept, F.from_json(F.col(body), CONTROL).alias("c")).select(*kept, "c.*")
    return c.where(F.col("op").isin("subscribe", "unsubscribe") & F.col("topics").isNotNull() | (F.col("op") == "replay") & F.col("topic").isNotNull())


def subscriptions(messages: DataFrame, order: str, client: str = "client") -> DataFrame:
    """(client, topic) pairs that hold after control messages (client, op, topics, and an order column)."""
    each = messages.where(F.col("op").isin("subscribe", "unsubscribe")).select(client, order, "op", F.explode("topics").alias("topic"))
    last = each.groupBy(client, "topic").agg(F.max_by("op", order).alias("op"))
    return last.where("op = 'subscribe'").select(client, "topic")


def lag(deliveries: DataFrame, capacity: int = 256, most: int = 1000, client: str = "client") -> DataFrame:
    """What clients that read nothing would miss of a batch: a queue drops its oldest ticks beyond its capacity, and whoever lost too many goes."""
    each = deliveries.groupBy(client).agg(F.count("*").alias("received"))
    lost = F.greatest(F.col("received") - capacity, F.lit(0).cast("long"))
    return each.select(client, "received", lost.alias("dropped"), (F.col("received") - capacity >= most).alias("disconnected"))
