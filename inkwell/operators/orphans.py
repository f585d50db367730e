"""Orphan references kept up to date batch by batch: a parent index and a table of waiting orphans.

State is tables in the shared folder, keyed by (ref_table, key):
  index    the instant from which a parent exists
  pending  references whose parent isn't there
  resolved references whose parent is there (only where deletions may come)
advance() takes one batch of references, arrivals and deletions. New references probe the index, arriving parents
resolve the waiting orphans of their key, deletions reopen the references that the key had resolved. Waiting orphans
meet only the arrivals of the batch, never the whole index. replay() brings the state up to a point of history at
once: batches are then numbers in a column, and every reference is joined once. Hot keys are salted, as one target may
be that of a third of all references.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.times import month, month_number
from inkwell.operators.skew import hot_keys, salted_join
from inkwell.session import cut, drop_cut

KEY = ["ref_table", "key"]
#: Instant (epoch microseconds) of parents that were there from the start.
ALWAYS = -(2**62)
REF_SCHEMA = "ref_table string, key string, source_id bigint, target string, at bigint"
PARENT_SCHEMA = "ref_table string, key string, since bigint"


_NAMES = ["ref_table", "key", "source_id", "target", "at"]
#: What a reference without a time counts as: after everything.
_NEVER = 2**62


@dataclass
class OrphanTracker:
    """Incremental orphan detection.

    References: ref_table, key, source_id, target, at (epoch microseconds, null counts as after everything).
    Arrivals: ref_table, key, since. Deletions: ref_table, key, at. References with a null key are none; repeated rows
    are kept as often as they come; of several arrivals of a key in a batch the earliest counts, and an arrival of a key
    that is there changes nothing. Empty batches change nothing.
    A reference at the very instant of its parent is resolved. keep_resolved: also store resolved references, which
    deletions then reopen; deletions without it raise ValueError. known: arrivals may be of keys that are
    there or come twice; False spares looking for them, where the caller sends each key once and from a stored table.
    """

    spark: SparkSession
    hot: DataFrame | None = None
    keep_resolved: bool = False
    known: bool = True
    index: DataFrame = field(init=False)
    pending: DataFrame = field(init=False)
    resolved: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.index = self.spark.createDataFrame([], PARENT_SCHEMA)
        self.pending = self.spark.createDataFrame([], REF_SCHEMA)
        self.resolved = self.spark.createDataFrame([], REF_SCHEMA)
        self.hot = self.spark.createDataFrame([], "ref_table string, key string") if self.hot is None else self.hot

    def replay(self, refs: DataFrame, arrivals: DataFrame, snapshots: list[int] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Bring an empty tracker to the end of history that has no deletions; returns the late references, and what
        waited at the end of each of the batches `snapshots` (batch, ref_table, period, pending), if any are given.

        Both tables have a number `batch`, and arrivals one row a key. A reference whose parent came with its batch or
        before is decided at once, any other waits from its own batch until that of its parent.
        """
        come = arrivals.select(*KEY, "since", F.col("batch").alias("__came")).where(F.col("key").isNotNull())
        joined = salted_join(refs.select(*_NAMES, "batch").where(F.col("key").isNotNull()), come, KEY, self.hot)
        open_ = F.col("since").isNull() | (F.col("since") > F.coalesce("at", F.lit(_NEVER)))
        probed = cut(joined if self.keep_resolved or snapshots else joined.where(open_), "probed")
        late = probed.where(F.col("since") > F.coalesce("at", F.lit(_NEVER))).select(*_NAMES)
        self.index = arrivals.select(*KEY, "since").where(F.col("key").isNotNull())
        self.pending = probed.where(F.col("since").isNull()).select(*_NAMES)
        if self.keep_resolved:
            self.resolved = probed.where(F.col("since").isNotNull()).select(*_NAMES)
        if not snapshots:
            return late, None
        # a line for each pair of batches, not for each reference, before it is spread over the batches it waits for
        waits = probed.where(F.col("__came").isNull() | (F.col("__came") > F.col("batch"))).groupBy("ref_table", month(F.col("at")).alias("period"), F.col("batch").alias("__from"), "__came").agg(F.count(F.lit(1)).alias("n"))
        batches = F.broadcast(self.spark.createDataFrame([(b,) for b in snapshots], "batch bigint"))
        held = waits.join(batches, (F.col("batch") >= F.col("__from")) & (F.col("__came").isNull() | (F.col("batch") < F.col("__came"))))
        return late, held.groupBy("batch", "ref_table", "period").agg(F.sum("n").alias("pending"))

    def advance(self, refs: DataFrame, arrivals: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
        """Take a batch; returns the references found orphaned that have a parent by now (late), ref columns only."""
        if deletions is not None and not self.keep_resolved:
            raise ValueError("deletions reopen resolved references, which only keep_resolved=True stores")
        refs = refs.select(*_NAMES).where(F.col("key").isNotNull())
        come = arrivals.select(*KEY, "since").where(F.col("key").isNotNull())
        if self.known:
            # only what is new is written; the index is the union of such parts
            come = come.groupBy(*KEY).agg(F.min("since").alias("since")).join(self.index.select(*KEY), KEY, "left_anti")
            come = cut(come, "index")
        index = self.index.unionByName(come)
        probed = salted_join(refs, index, KEY, self.hot).select(*_NAMES, "since")
        woken = salted_join(self.pending, come, KEY, self.hot).select(*_NAMES, "since")
        both = probed.unionByName(woken)
        if not self.keep_resolved:
            both = both.where(F.col("since").isNull() | (F.col("since") > F.coalesce("at", F.lit(_NEVER))))
        probed = cut(both, "probed")
        late = probed.where(F.col("since") > F.coalesce("at", F.lit(_NEVER))).select(*_NAMES)
        pending = probed.where(F.col("since").isNull()).select(*_NAMES)
        found = probed.where(F.col("since").isNotNull()).select(*_NAMES)
        if deletions is not None:
            gone = deletions.where(F.col("key").isNotNull()).groupBy(*KEY).agg(F.max("at").alias("gone"))
            index = cut(index.join(gone, KEY, "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("since"))).select(*KEY, "since"), "index")
            # only the resolved references of deleted keys are looked at again
            back = gone.join(index.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(True).alias("__gone"))
            seen = salted_join(self.resolved.unionByName(found), back, KEY, self.hot)
            reopened = seen.where("__gone").select(*_NAMES)
            pending, self.resolved = cut(pending.unionByName(reopened), "pending"), cut(seen.where(F.col("__gone").isNull()).select(*_NAMES), "resolved")
        elif self.keep_resolved:
            self.resolved = self.resolved.unionByName(found)
        self.index, self.pending = index, pending
        return late

    def snapshot(self) -> DataFrame:
        """Waiting orphans by table and month of the reference."""
        return self.pending.groupBy("ref_table", month(F.col("at")).alias("period")).agg(F.count(F.lit(1)).alias("pending"))


def _month(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))


def track(
    refs: DataFrame, arrivals: DataFrame, months: int = 1, hot_share: float = 0.005, snapshots: list[DataFrame] | None = None, deletions: DataFrame | None = None, live: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Run a tracker over all history in batches of some months; returns late and absent references.

    Batches go by the references' `at`; arrivals join the batch in which they fall, those before the first reference the
    first batch, those after the last one the last. References without a key or time come with the last batch.
    All batches but the last `live` ones are replayed at once, those are then taken one by one. Deletions (ref_table,
    key, at) go by their `at` like arrivals; with any, every batch is taken by itself.
    snapshots: gets what waited after the batches, with the first month of the batch as `batch`.
    """
    spark = refs.sparkSession
    number = lambda at: F.floor(month_number(F.col(at)) / months).cast("bigint")
    single = deletions is not None or live > 1
    staged = cut(refs.select(*_NAMES, number("at").alias("batch")), "refs", ["batch"] if single else None)
    batches = [r[0] for r in staged.select("batch").where("batch is not null").distinct().orderBy("batch").collect()]
    last = max(batches, default=0)

    def placed(batch: Column) -> Column:
        """The batch an event falls in: the first reference batch that isn't before it, else the last one."""
        return reduce(lambda c, b: c.when(batch <= b, b), batches, F.when(batch.isNull(), last)).otherwise(last).cast("bigint")

    parents = arrivals.groupBy(*KEY).agg(F.min("since").alias("since"))
    parents = cut(parents.withColumn("batch", placed(F.when(F.col("since") > ALWAYS, number("since")).otherwise(-(2**40)))), "parents", ["batch"] if single else None)
    hot = cut(hot_keys(staged, KEY, hot_share), "hot")
    tracker = OrphanTracker(spark, hot, keep_resolved=deletions is not None, known=False)
    alone = batches if deletions is not None else batches[len(batches) - live :] if live < len(batches) else batches[-1:]
    before = [b for b in batches if b not in alone]
    late = staged.select(*_NAMES).limit(0)
    if before:
        upto = F.col("batch") <= before[-1]
        late, waited = tracker.replay(staged.where(upto), parents.where(upto), before if snapshots is not None else None)
        if snapshots is not None:
            snapshots.append(waited.select(_month(F.col("batch") * months).alias("batch"), "ref_table", "period", "pending"))
    gone = None if deletions is None else cut(deletions.select(*KEY, "at", placed(number("at")).alias("batch")), "deletions")
    for b in alone or [0]:
        mine = F.col("batch") == b
        taken = mine | F.col("batch").isNull() if b == last else mine
        found = tracker.advance(staged.where(taken).drop("batch"), parents.where(mine).drop("batch"), gone.where(mine) if gone is not None else None)
        late = late.unionByName(found)
        if snapshots is not None and batches:
            snapshots.append(tracker.snapshot().select(_month(F.lit(b * months)).alias("batch"), "ref_table", "period", "pending"))
    # what is returned rests on the probed references only
    for used in (staged, parents, hot, gone):
        drop_cut(used)
    return late, tracker.pending
