"""All nine history features over a stream of transactions, for both roles, with state kept as tables and a sink that is published at the clean end.

Each epoch (micro-batch) meets its rows by pair, with the pairs of the state, to mark those that are new, and sums them map-side to one per entity and step, so a hub with a third of all rows sends the state one row per step, and joins the prior sums back to the rows in equi-joins that AQE can split. State is three relations in the work folder: `pairs`
(initiator and recipient that have met, with no order to keep: a pair is appended when it is first seen), and `initiators` and `recipients`, one row per entity with what is committed (all steps before its last one) and what is pending (its last step), so rows of one step never see each
other, in whatever epochs they come. An epoch appends the rows of the entities that it touched; the newest row of an entity counts, and each COMPACT epochs one folder is written that replaces those before it.

A row of an earlier step than an earlier epoch's last one raises and ends the query: history was emitted without it. What an epoch writes is named by its number and overwritten when it is replayed, and it reads only earlier epochs, so a query that died gives each row once when it is
started again. Rows are staged in the work folder, and become the target by one rename in publish(); until then there is no target.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import exists, filesystem, materialize, rename
from ..operators.features import emitted, marked, step_sums, with_prior
from ..sources.artifact import read_text, write_text

#: Epochs after which the state is written anew in one folder.
COMPACT = 16
SUMS = ["n", "transfers", "total", "most", "fresh"]
STATE = {"initiator_id": "initiators", "recipient_id": "recipients"}


def _folders(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """Epoch, whether it holds all of the state, and path of each epoch's folder."""
    fs, where = filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted((int(n.split("-")[0]), n.endswith("-whole"), f"{path}/{n}") for n in names if n[:1].isdigit())


def _read(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """The rows of the epochs before one, from the last whole folder on, with the epoch of each; None if there are none."""
    found = [f for f in _folders(spark, path) if f[0] < epoch]
    start = max((e for e, whole, _ in found if whole), default=-1)
    parts = [spark.read.parquet(p).withColumn("epoch", F.lit(e)) for e, _, p in found if e >= start]
    out = parts[0] if parts else None
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _write(df: DataFrame, path: str, epoch: int, whole: bool) -> None:
    """An epoch's folder; those that a whole one has replaced for good go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{epoch:012d}{'-whole' if whole else ''}")
    before = [f for f in _folders(spark, path) if f[0] < epoch]
    last = max((e for e, is_whole, _ in before if is_whole), default=-1)
    for e, _, old in before:
        if e < last:
            fs, where = filesystem(spark, old)
            fs.delete(where, True)


def _newest(rows: DataFrame, entity: str) -> DataFrame:
    """The newest row of each entity."""
    held = [c for c in rows.columns if c not in (entity, "epoch")]
    return rows.groupBy(entity).agg(F.max_by(F.struct(*held), "epoch").alias("s")).select(entity, *[F.col(f"s.{c}").alias(c) for c in held])


def _clock(spark: SparkSession, work: str, epoch: int) -> int:
    """The last step of all epochs before one; -1 at the beginning."""
    found = [f for f in _folders(spark, f"{work}/clock") if f[0] < epoch]
    return json.loads(read_text(spark, found[-1][2]))["step"] if found else -1


def _entities(steps: DataFrame, entity: str, work: str, epoch: int) -> DataFrame:
    """Prior sums at each (entity, step) of an epoch's sums, after the state of the entities has been carried on and written."""
    spark, path, whole = steps.sparkSession, f"{work}/{STATE[entity]}", epoch % COMPACT == COMPACT - 1
    known = _read(spark, path, epoch)
    seeded = steps
    if known is not None:
        held = _newest(known.join(steps.select(entity).distinct(), entity, "left_semi"), entity)
        committed = held.select(entity, F.lit(-1).alias("step"), *SUMS)
        pending = held.select(entity, "step", *[F.col(f"p_{c}").alias(c) for c in SUMS])
        seeded = steps.unionByName(committed).unionByName(pending).groupBy(entity, "step").agg(*[F.sum(c).cast(steps.schema[c].dataType).alias(c) for c in SUMS if c != "most"], F.max("most").alias("most"))
    priors = materialize(with_prior(seeded, entity), "priors")
    last = priors.groupBy(entity).agg(F.max_by(F.struct(*priors.columns), "step").alias("s"))
    after = last.select(entity, F.col("s.step").alias("step"), *[F.col(f"s.prior_{c}").cast(steps.schema[c].dataType).alias(c) for c in SUMS], *[F.col(f"s.{c}").alias(f"p_{c}") for c in SUMS])
    if whole and known is not None:
        after = after.unionByName(_newest(known.join(steps.select(entity).distinct(), entity, "left_anti"), entity))
    _write(after, path, epoch, whole)
    return priors


def process(batch: DataFrame, epoch: int, work: str, keep: list[str], exact: bool = False) -> int:
    """One epoch: the batch's TRANSFER rows with their features are staged, and the state is carried on. Its number of rows."""
    spark = batch.sparkSession
    whole, met = epoch % COMPACT == COMPACT - 1, _read(spark, f"{work}/pairs", epoch)
    events = materialize(marked(batch, keep, met=met), "marked")
    first, last, n = events.agg(F.min("step"), F.max("step"), F.count("*")).first()
    clock = _clock(spark, work, epoch)
    if first is not None and first < clock:
        raise ValueError(f"chronological regression: step {first} after step {clock}")
    pairs = events.where("__fresh = 1").select(*STATE)
    _write(pairs.unionByName(met.select(*STATE)) if whole and met is not None else pairs, f"{work}/pairs", epoch, whole)
    priors = {}
    for entity in STATE:
        steps = step_sums(events, entity)
        wide = steps.schema["total"].dataType
        steps = steps.withColumn("total", F.col("total").cast(T.DecimalType(38, wide.scale) if isinstance(wide, T.DecimalType) else wide))
        priors[entity] = _entities(materialize(steps, "steps"), entity, work, epoch)
    emitted(events.drop("__fresh"), priors["initiator_id"], priors["recipient_id"], exact).write.mode("overwrite").parquet(f"{work}/staged/epoch={epoch}")
    fs, where = filesystem(spark, f"{work}/clock/{epoch:012d}")
    fs.delete(where, True)
    write_text(spark, f"{work}/clock/{epoch:012d}", json.dumps({"step": clock if last is None else max(clock, last)}))
    return n or 0


def run_available(stream: DataFrame, work: str, keep: list[str], exact: bool = False, after: Callable[[int], None] | None = None) -> dict[str, int]:
    """Process all that a streaming DataFrame has now, from where the work folder's checkpoint says: the epochs of this run, and the rows that it read. after is called with each epoch's number before it is committed."""

    counts = []

    def step(batch: DataFrame, epoch: int) -> None:
        counts.append(process(batch, epoch, work, keep, exact))
        if after is not None:
            after(epoch)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return {"epochs": len(counts), "rows": sum(counts)}


def publish(spark: SparkSession, work: str, target: str) -> DataFrame:
    """Make what is staged the target, by one rename; an existing target is refused. Rows bear the epoch that they came in."""
    if exists(spark, target):
        raise FileExistsError(target)
    fs, parent = filesystem(spark, target.rstrip("/").rpartition("/")[0])
    fs.mkdirs(parent)
    rename(spark, f"{work}/staged", target)
    return spark.read.parquet(target)


def statistics(spark: SparkSession, work: str) -> dict[str, int]:
    """What the state holds after all epochs: initiators, recipients, pairs, and the last step."""
    end = 1 << 40
    counts = {name: (0 if (rows := _read(spark, f"{work}/{name}", end)) is None else rows.select(entity).distinct().count()) for entity, name in STATE.items()}
    pairs = _read(spark, f"{work}/pairs", end)
    return counts | {"pairs": 0 if pairs is None else pairs.select(*STATE).distinct().count(), "last_step": _clock(spark, work, end)}
