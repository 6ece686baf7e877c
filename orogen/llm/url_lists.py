"""URL filters: a temporal join of captures with dated block-list entries.

Entries ``pattern, action, effective`` ('add' or 'remove' a host or domain from a date on) become validity intervals;
a capture is blocked by the intervals of its host and parent domains that hold at its fetch time.

Scale: only distinct (host, fetch time) pairs meet the list, so a hot host costs its distinct times and not its rows.
Domains without an entry go first, by counts that are added up before they are shuffled, so what half of all hosts share
(a top-level domain) meets nothing unless it is listed itself. Pairs are merged with the changes of each domain in order
of time, so a domain of many intervals is no join of pairs; the pairs under one domain are dealt to as many groups as
they fill, to each of which its changes are copied. The verdicts come back by an equi-join. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Pairs of host and time that meet a domain's changes together, about.
GROUP = 100_000
#: Listed domains up to which they go to every task; more are joined by a shuffle.
FEW = 100_000
_STATE = "struct<since:date>"


def host_of(url: str = "url"):
    """Lower-case host of a URL with or without its scheme (``//host/``), without user, port and the dots of a full name
    at its end; null where there is none."""
    authority = F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    named = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(F.length(named) > 0, named)


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to`` (exclusive; null: still valid) while a pattern is on the list.

    Entries with a null in any of the three columns, or another action, are left out. Of several entries of a pattern
    with one date, 'remove' counts. An 'add' while the pattern is on the list goes on with the interval.
    """
    usable = entries.where(F.col("pattern").isNotNull() & F.col("effective").isNotNull() & F.col("action").isin("add", "remove"))
    dated = usable.groupBy(F.regexp_replace(F.lower("pattern"), r"\.+$", "").alias("pattern"), "effective").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("effective")
    turns = dated.withColumn("before", F.lag("action", 1, "remove").over(order)).where("action <> before")
    return (
        turns.withColumn("valid_to", F.lead("effective").over(order))
        .where("action = 'add'")
        .select("pattern", F.col("effective").alias("valid_from"), "valid_to")
    )


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, host, fetched, blocked, pattern, listed_since`` per row of ``captures`` (page_id, url, fetched).

    ``pattern`` is the most specific one in force: the host, or a domain above it (an IPv4 address has none). A null or
    relative url, or a null time, is not blocked. Rows that repeat each get a result; columns of other names are
    ignored. Entries are hosts, domains or addresses, with or without a dot at their end; one that is a URL or a path has
    no effect, and an empty list blocks nothing.
    """
    rows = captures.select("page_id", host_of().alias("host"), "fetched")
    pairs = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(F.col("host").rlike(r"^[0-9.]+$"), F.array("host")).otherwise(above)
    listed = intervals(entries)
    state = lambda since: F.struct(since.alias("since")).cast(_STATE)
    changes = listed.select("pattern", F.col("valid_from").alias("at"), state(F.col("valid_from")).alias("state"))
    changes = changes.union(listed.where("valid_to is not null").select("pattern", "valid_to", state(F.lit(None).cast("date"))))
    spread = pairs.select("host", F.col("fetched").alias("at"), F.explode(domains).alias("domain"))
    named = listed.select(F.col("pattern").alias("domain")).distinct()
    counted = spread.groupBy("domain").count().join(named, "domain")
    groups = materialize(counted.select("domain", F.ceil(F.col("count") / GROUP).cast("int").alias("groups")), "domains")
    side = F.broadcast(groups) if groups.count() <= FEW else groups
    nothing = F.lit(None).cast(_STATE).alias("state")
    salt = F.pmod(F.xxhash64("host", "at"), F.col("groups")).cast("int").alias("salt")
    asked = spread.join(side, "domain").select("domain", salt, "at", F.lit(1).alias("turn"), "host", nothing)
    salts = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")
    events = changes.withColumnRenamed("pattern", "domain").join(side, "domain").select("domain", salts, "at", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("host"), "state")
    # Changes and captures of a domain in one order of time: a capture has the state that the last change before it left.
    order = Window.partitionBy("domain", "salt").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.union(events).withColumn("state", F.last("state", ignorenulls=True).over(order)).where("turn = 1 and state.since is not null")
    verdicts = met.groupBy(F.col("host").alias("vh"), F.col("at").alias("vf")).agg(F.max_by(F.struct(F.col("domain").alias("pattern"), F.col("state.since").alias("valid_from")), F.length("domain")).alias("v"))
    joined = rows.join(verdicts, (F.col("host") == F.col("vh")) & (F.col("fetched") == F.col("vf")), "left")
    return joined.select("page_id", "host", "fetched", F.col("v").isNotNull().alias("blocked"), F.col("v.pattern").alias("pattern"), F.col("v.valid_from").alias("listed_since"))
