"""The opportunity queue fed by a stream of finished runs: each micro-batch is folded in order, late runs go to a table of rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.shared import checkpointed
from siftline.operators import queue_state
from siftline.sources.commits import Change, Commit, Tables, part_of

#: A run as it comes, and the tables that a batch changes together.
RUN = "site string, run_id string, completed_at string"
STREAM = "queue"


def fold(runs: DataFrame, state: DataFrame, syncs: DataFrame, derive: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs: site, run_id, completed_at, in any number. -> state, syncs, late runs.

    derive(runs) gives what they found, judge(state, runs) verdicts on what they didn't. Sites advance together, one run each at
    a time, so there are as many merges as one site has runs.
    """
    late = None
    order = Window.partitionBy("site").orderBy("completed_at", "run_id")
    numbered = checkpointed(runs.withColumn("_nth", F.row_number().over(order)))
    for k in range(1, (numbered.agg(F.max("_nth")).first()[0] or 0) + 1):
        turn = queue_state.check_order(numbered.where(F.col("_nth") == k).drop("_nth"), syncs)
        refused = turn.where("action = 'late'").drop("action")
        late = refused if late is None else late.unionByName(refused)
        due = checkpointed(turn.where("action = 'sync'").drop("action"))
        now = due.agg(F.max("completed_at")).first()[0]
        if now is not None:
            state, syncs, _ = (checkpointed(x) for x in queue_state.sync(state, syncs, due, derive(due), judge(state, due), now))
    return state, syncs, late if late is not None else runs.limit(0)


def apply(tables: Tables, batch: DataFrame, number: int, derive: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame]) -> Commit:
    """Fold a batch into the stored queue by one commit of state, syncs, late runs and the batch's number.

    Tables are cut by site: only the parts of the batch's sites are read and replaced. A batch whose number has been committed changes nothing,
    whenever its first run was killed.
    """
    runs = checkpointed(batch.select("site", "run_id", "completed_at"))
    site = part_of(F.col("site"))
    parts = tuple(sorted(r[0] for r in runs.select(site).distinct().collect()))  # at most PARTS numbers

    def change(base: Commit) -> dict[str, Change]:
        read = lambda table, schema: tables.read(table, schema, base, list(parts))
        state, syncs, late = fold(runs, read("state", queue_state.STATE), read("syncs", queue_state.SYNCS), derive, judge)
        refused = read("late", RUN).unionByName(late.select("site", "run_id", "completed_at"))
        return {name: Change(rows.withColumn("part", site), parts) for name, rows in (("state", state), ("syncs", syncs), ("late", refused))}

    return tables.update(change, (STREAM, number))


def start(runs: DataFrame, folder: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Fold each micro-batch into the queue under folder; ``Tables(spark, folder).read`` gives state, syncs and late."""

    def each(batch: DataFrame, number: int) -> None:
        apply(Tables(batch.sparkSession, folder), batch, number, derive, judge)

    return runs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
