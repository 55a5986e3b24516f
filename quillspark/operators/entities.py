"""One series for each entity: new records that share ids are assigned together.

A record has an id of its own at its provider and foreign ids.  Ids lead to at
most one series, and a series has at most one id of a provider; of several that
could have a place the first record has it.  Rounds go on until all records
have a series:

* records that an id leads to a series join it (their own id before foreign
  ones, these in their order; series that have another id of the record's
  provider are passed over) and bring their ids along;
* when none is left to join, the others are connected by the ids that they
  share.  An id connects the first record of each provider that lists it, as
  no second one could join the same series, so a frequent id has few edges.  In
  each connected group the first id of a provider stays, and what is still
  connected founds one series; the rest takes part in the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled
from quillspark.operators.merges import insert_external_ids

#: Ranges by which new series are numbered.
RANGES = 256


def components(edges: DataFrame) -> DataFrame:
    """``record``, ``component`` of a bipartite graph (``record`` long, ``node``): the smallest record that can be reached.

    Each round takes the least label over the nodes and then the label's own
    label, so labels travel twice as far each time.
    """
    edges = settled(edges.distinct())
    labels = settled(edges.select("record").distinct().withColumn("component", F.col("record")))
    while True:
        near = edges.join(labels, "record").groupBy("node").agg(F.min("component").alias("least"))
        reached = settled(edges.join(near, "node").groupBy("record").agg(F.min("least").alias("component")))
        up = reached.select(F.col("record").alias("component"), F.col("component").alias("up"))
        new = settled(reached.join(up, "component").select("record", F.least("component", "up").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "was"), "record").where("component <> was").limit(1).count()
        labels = new
        if not moved:
            return labels


def _ids(records: DataFrame) -> DataFrame:
    """One row for each id of a record, its own at position 0."""
    own = F.struct(F.col("provider").alias("provider"), F.col("external_id").alias("id"))
    foreign = F.coalesce("foreign_ids", F.array().cast("array<struct<provider:string,id:string>>"))
    listed = records.select("place", "provider", "external_id", F.posexplode(F.concat(F.array(own), F.transform(foreign, lambda f: F.struct(f["provider"].alias("provider"), f["id"].alias("id"))))).alias("pos", "i"))
    rows = listed.select("place", "provider", "external_id", "pos", F.col("i.provider").alias("id_provider"), F.col("i.id").alias("id"))
    return rows.where("id_provider is not null and id is not null")


def _with_ids(known: DataFrame, ids: DataFrame, joined: DataFrame) -> DataFrame:
    """``known`` with the ids of records (``place``, ``series_id``) that joined a series."""
    brought = ids.join(joined, "place").select(F.col("id_provider").alias("provider"), F.col("id").alias("external_id"), "series_id", F.struct("place", "pos").alias("place"))
    # a record's own id has its place already: it comes before any foreign id of that provider
    own = brought.where("place.pos = 0").groupBy("provider", "external_id", "series_id").agg(F.min("place").alias("place"))
    with_own = insert_external_ids(known, own)
    return insert_external_ids(with_own, brought.where("place.pos > 0"))


def assign(records: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The series of each record, and the mapping with all ids.

    ``records``: ``place`` (long, unique: the order), ``provider``,
    ``external_id``, ``foreign_ids`` (array of provider, id); ``mapping``:
    ``provider``, ``external_id``, ``series_id``, whose ids are not negative.
    Returns ``place``, ``series_id`` (null for a new series), ``founder`` (the
    place of the first record of a new series, else null), and ``provider``,
    ``external_id``, ``series_id``, ``founder``.  Records without an id of
    their own found nothing and are left out.
    """
    rest = settled(_ids(records.where("provider is not null and external_id is not null")))
    known = settled(mapping.select("provider", "external_id", F.col("series_id").cast("bigint").alias("series_id")))
    done = []
    while rest.limit(1).count():
        hits = rest.join(known.select(F.col("provider").alias("id_provider"), F.col("external_id").alias("id"), "series_id"), ["id_provider", "id"])
        held = known.select("provider", "series_id", F.col("external_id").alias("held"))
        free = hits.join(held, ["provider", "series_id"], "left").where("pos = 0 or held is null or held = external_id")
        target = settled(free.groupBy("place", "provider", "external_id").agg(F.min_by(F.struct("series_id", "held"), F.struct("pos", "series_id")).alias("t")))
        if target.limit(1).count():
            # a free place goes to the first record's id, and to all records with that id
            first = target.where("t.held is null").groupBy(F.col("t.series_id").alias("series_id"), "provider").agg(F.min_by("external_id", "place").alias("taken"))
            joined = target.select("place", "provider", "external_id", "t.series_id", "t.held").join(first, ["series_id", "provider"], "left")
            joined = settled(joined.where("held is not null or external_id = taken").select("place", "series_id"))
        else:
            joined = settled(_founded(rest))
        done.append(joined)
        known = settled(_with_ids(known, rest, joined))
        rest = settled(rest.join(joined, "place", "left_anti"))
    every = done[0] if done else rest.select("place", F.lit(None).cast("bigint").alias("series_id")).limit(0)
    for more in done[1:]:
        every = every.unionByName(more)
    stored, founder = F.when(F.col("series_id") >= 0, F.col("series_id")).alias("series_id"), F.when(F.col("series_id") < 0, -F.col("series_id") - 1).alias("founder")
    return every.select("place", stored, founder), known.select("provider", "external_id", stored, founder)


def _founded(ids: DataFrame) -> DataFrame:
    """``place``, ``series_id`` (minus the founder's place, minus 1) of the records that found series in this round."""
    first = ids.groupBy("id_provider", "id", "provider").agg(F.min_by("external_id", "place").alias("first"))
    edges = ids.join(first, ["id_provider", "id", "provider"]).where("external_id = first").select(F.col("place").alias("record"), F.struct("id_provider", "id").alias("node"), "provider", "external_id")
    edges = settled(edges)
    group = components(edges.select("record", "node"))
    own = edges.select("record", "provider", "external_id").distinct().join(group, "record")
    stays = own.groupBy("component", "provider").agg(F.min_by("external_id", "record").alias("external_id"))
    kept = settled(own.join(stays, ["component", "provider", "external_id"]).select("record"))
    left = edges.join(kept, "record", "left_semi")
    return components(left.select("record", "node")).select(F.col("record").alias("place"), (-F.col("component") - 1).alias("series_id"))


def numbered_founders(assigned: DataFrame, last: int) -> DataFrame:
    """``founder``, ``new_id``: numbers after ``last`` in the order of the founders, without one task that sees all of them."""
    founders = settled(assigned.where("founder is not null").select("founder").distinct())
    ends = founders.agg(F.min("founder").alias("_a"), F.max("founder").alias("_b"))
    width = F.ceil((F.col("_b") - F.col("_a") + 1) / F.lit(RANGES))
    ranged = founders.crossJoin(F.broadcast(ends)).select("founder", F.floor((F.col("founder") - F.col("_a")) / width).cast("int").alias("_r"))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy("founder"))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_r").select("founder", (F.lit(last) + F.col("_before") + F.col("_own")).cast("bigint").alias("new_id"))


def persist(series: DataFrame, mapping: DataFrame, records: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series, mapping and ``place``, ``series_id`` after all ``records`` have been assigned.

    ``records`` has what :func:`assign` needs and columns of ``series``; a new
    series takes those of its founder, comes from the provider and is stamped ``now``.
    """
    assigned, known = assign(records, mapping)
    assigned, known = settled(assigned), settled(known)
    last = series.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbers = settled(numbered_founders(assigned, last))
    fixed = {"id": F.col("new_id"), "metadata_source": F.lit("provider"), "updated_at": F.lit(0), "created_at": F.lit(now), "fetched_at": F.lit(now)}
    made = records.withColumnRenamed("place", "founder").join(numbers, "founder")
    made = made.select(*[(fixed[c] if c in fixed else F.col(c) if c in records.columns else F.lit(None)).cast(series.schema[c].dataType).alias(c) for c in series.columns])
    own = lambda df: df.join(numbers, "founder", "left").withColumn("series_id", F.coalesce("series_id", "new_id"))
    return series.unionByName(made), own(known).select("provider", "external_id", "series_id"), own(assigned).select("place", "series_id")
