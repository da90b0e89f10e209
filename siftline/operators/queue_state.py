"""The opportunity queue: what each audit run does to the stored opportunities, as one full outer merge.

A sync is idempotent (the latest synced run of a site changes nothing) and in order (a run that completed before it is refused).
States are versions of a table in a folder of their own; a pointer file, replaced at last, names the current one.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.shared import checkpointed
from siftline.functions.urls import document_url

# Ranks, statuses, and caps on history and reasons.
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
STATUS_RANK = {"open": 0, "planned": 1, "verified": 2, "dismissed": 3}
OBSERVATION_RANK = {"present": 0, "unknown": 1, "not_observed": 2}
MANUAL = ("open", "planned", "dismissed")
HISTORY, REASON, LIST, MAX_LIST, AFFECTED = 100, 500, 20, 100, 20

EVENT = "struct<at:string,event:string,run_id:string,from_status:string,to_status:string,reason:string>"
STATE = f"""id string, site string, source string, kind string, comparison_key string, priority string, status string, status_reason string,
observation_state string, first_seen_at string, last_seen_at string, latest_run_id string, occurrences bigint, verified_older string, verified_newer string,
verified_at string, history array<{EVENT}>"""
SYNCS = "site string, latest_run_id string, completed_at string, synced_at string"


#: Names the current version. A leading underscore would hide it from readers. A lock older than LEASE_MS is a dead writer's.
POINTER, LOCK, KEEP, LEASE_MS = "CURRENT", "LOCK", 3, 10 * 60_000


class OutOfOrder(ValueError):
    """A run that completed before the latest synced run of its site."""


def normalized_site(url: Column) -> Column:
    clean = document_url(url)
    return F.when(url.rlike(r"(?i)^https?://"), clean).otherwise(F.lower(F.trim(url)))


def opportunity_id(site: Column, source: Column, key: Column) -> Column:
    return F.concat(F.lit("opp_"), F.substring(F.sha2(F.concat_ws("\0", F.lit("opportunity-v1"), normalized_site(site), source, key), 256), 1, 24))


def _event(now: str, event: Column | str, run: Column, before: Column, after: Column, reason: Column) -> Column:
    name = F.lit(event) if isinstance(event, str) else event
    return F.struct(F.lit(now).alias("at"), name.alias("event"), run.alias("run_id"), before.alias("from_status"), after.alias("to_status"), reason.alias("reason"))


def _appended(history: Column, event: Column) -> Column:
    """The last HISTORY events with one more."""
    longer = F.concat(F.coalesce(history, F.array().cast(f"array<{EVENT}>")), F.array(event.cast(EVENT)))
    return F.slice(longer, F.greatest(F.size(longer) - HISTORY + 1, F.lit(1)), HISTORY)


def check_order(runs: DataFrame, syncs: DataFrame) -> DataFrame:
    """runs: site, run_id, completed_at -> with action: sync, repeat (already the latest) or late. Equal times are in order."""
    last = syncs.select("site", F.col("latest_run_id").alias("_last"), F.col("completed_at").alias("_at"))
    action = F.when(F.col("_last") == F.col("run_id"), "repeat").when(F.col("_at") > F.col("completed_at"), "late").otherwise("sync")
    return runs.join(last, "site", "left").withColumn("action", action).drop("_last", "_at")


def sync(state: DataFrame, syncs: DataFrame, runs: DataFrame, derived: DataFrame, absent: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of each of many sites -> the new state, the new syncs, and each opportunity's outcome. The merge runs once, into a checkpoint.

    runs: site, run_id, completed_at. derived: site, source, kind, comparison_key, priority (what the runs found). absent: site,
    source, comparison_key, latest_run_id, verdict for stored ones that the run didn't find, by the run they were last seen in:
    resolved, unknown, incomparable, gone or missing (no such run on record).
    """
    checked = check_order(runs, syncs)
    late = checked.where("action = 'late'").select("site", "run_id").take(1)
    if late:
        raise OutOfOrder(f"run {late[0]['run_id']} of {late[0]['site']} completed before the latest synced run")
    due = checked.where("action = 'sync'").select("site", F.col("run_id").alias("_run"), F.col("completed_at").alias("_done"))
    found = derived.join(due.select("site"), "site", "left_semi").withColumn("id", opportunity_id(F.col("site"), F.col("source"), F.col("comparison_key")))
    found = found.groupBy("id").agg(F.max(F.struct("site", "source", "kind", "comparison_key", "priority")).alias("d"))
    verdicts = absent.select(opportunity_id(F.col("site"), F.col("source"), F.col("comparison_key")).alias("id"), F.col("latest_run_id").alias("_seen_in"), "verdict").distinct()
    cells = [c for c in state.columns if c != "id"]
    stored = state.select("id", F.struct(*cells).alias("s"))
    merged = stored.join(found, "id", "full_outer").withColumn("site", F.coalesce("s.site", "d.site")).join(due, "site", "left")
    merged = merged.join(verdicts, (merged["id"] == verdicts["id"]) & (F.col("s.latest_run_id") == F.col("_seen_in")), "left").drop(verdicts["id"])
    s, d, run = F.col("s"), F.col("d"), F.col("_run")
    verdict = F.coalesce("verdict", F.lit("missing"))
    done = (s.observation_state == "not_observed") & s.verified_at.isNotNull() & s.status.isin("verified", "dismissed")
    outcome = (
        F.when(run.isNull(), "untouched")
        .when(s.isNull(), "created")
        .when(d.isNotNull(), F.when(s.status == "verified", "reopened").otherwise("updated"))
        .when(verdict == "missing", "unknown")
        .when((verdict == "resolved") & (s.source == "technical"), F.when(done, "unchanged").otherwise("verified"))
        .when(verdict == "gone", F.when(s.observation_state == "not_observed", "unchanged").otherwise("not_observed"))
        # a search item of a comparable but incomplete run goes to unknown without an entry in its history
        .when((s.source != "technical") & (verdict == "unknown"), "unknown_quietly")
        .otherwise(F.when(s.observation_state == "unknown", "unchanged").otherwise("unknown"))
    )
    o = F.col("_outcome")
    present = o.isin("created", "updated", "reopened")
    status = F.when(o == "created", "open").when(o == "reopened", "open").when((o == "verified") & (s.status != "dismissed"), "verified").otherwise(s.status)
    reason = F.when(o == "created", "first observed").when(o == "reopened", "observed again after it was verified").when(o == "updated", "observed again").when(o == "verified", "absent where it was looked for again").when(o == "not_observed", "absent from a comparable later period").otherwise("no comparable evidence")
    event = F.when(o == "created", "created").when(o == "reopened", "reopened").when(o == "updated", "observed").when(o == "unknown", "observation_unknown").otherwise(o)
    observed = F.when(present, "present").when(o.isin("verified", "not_observed"), "not_observed").when(o.isin("unknown", "unknown_quietly"), "unknown").otherwise(s.observation_state)
    entered = o.isin("created", "reopened", "updated", "verified", "not_observed", "unknown")
    judged = merged.withColumn("_outcome", outcome)
    new = checkpointed(judged.select(
        "id", "site", F.coalesce(d.source, s.source).alias("source"), F.coalesce(d.kind, s.kind).alias("kind"), F.coalesce(d.comparison_key, s.comparison_key).alias("comparison_key"),
        F.coalesce(d.priority, s.priority).alias("priority"), status.alias("status"),
        F.when(o == "reopened", None).when((o == "verified") & (s.status != "dismissed"), reason).otherwise(s.status_reason).alias("status_reason"), observed.alias("observation_state"),
        F.when(o == "created", F.col("_done")).otherwise(s.first_seen_at).alias("first_seen_at"), F.when(present, F.col("_done")).otherwise(s.last_seen_at).alias("last_seen_at"),
        F.when(present, run).otherwise(s.latest_run_id).alias("latest_run_id"), (F.coalesce(s.occurrences, F.lit(0)) + present.cast("int")).cast("long").alias("occurrences"),
        F.when(o == "verified", s.latest_run_id).when(present, None).otherwise(s.verified_older).alias("verified_older"),
        F.when(o == "verified", run).when(present, None).otherwise(s.verified_newer).alias("verified_newer"),
        F.when(o == "verified", now).when(present, None).otherwise(s.verified_at).alias("verified_at"),
        F.when(entered, _appended(s.history, _event(now, event, run, s.status, status, reason))).otherwise(s.history).alias("history"), o.alias("_outcome"),
    ))
    newer = due.select("site", F.col("_run").alias("latest_run_id"), F.col("_done").alias("completed_at"), F.lit(now).alias("synced_at"))
    kept = syncs.join(due.select("site"), "site", "left_anti").select("site", "latest_run_id", "completed_at", "synced_at")
    outcomes = new.where("_outcome <> 'untouched'").select("id", "site", "priority", F.when(F.col("_outcome") == "unknown_quietly", "unknown").otherwise(F.col("_outcome")).alias("outcome"))
    return new.drop("_outcome"), kept.unionByName(newer), outcomes


def changes(outcomes: DataFrame) -> DataFrame:
    """Counts by site; a reopened item counts as updated too."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("site").agg(n("created").alias("created"), n("updated", "reopened").alias("updated"), n("reopened").alias("reopened"), n("verified").alias("verified"), n("not_observed").alias("not_observed"), n("unknown").alias("unknown"), n("unchanged").alias("unchanged"))


def _rank(column: Column, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), column)


def affected(outcomes: DataFrame, n: int = AFFECTED) -> DataFrame:
    return outcomes.where("outcome <> 'unchanged'").orderBy(_rank(F.col("priority"), PRIORITY_RANK), "id").limit(n)


def update_status(state: DataFrame, opportunity: str, status: str, reason: str, now: str) -> DataFrame:
    """A manual status. The same status and reason change nothing; another reason alone is an event of its own kind."""
    reason = reason.strip()
    if status not in MANUAL:
        raise ValueError("the status must be open, planned or dismissed; verified comes from evidence alone")
    if not 1 <= len(reason) <= REASON:
        raise ValueError(f"the reason must have 1 to {REASON} characters")
    if not state.where(F.col("id") == opportunity).take(1):
        raise LookupError(f"no opportunity {opportunity}")
    mine = F.col("id") == opportunity
    moved = F.col("status") != status
    differs = mine & (moved | ~F.col("status_reason").eqNullSafe(F.lit(reason)))
    event = _event(now, F.when(moved, "status_changed").otherwise("status_updated"), F.lit(None).cast("string"), F.col("status"), F.lit(status), F.lit(reason))
    history = F.when(differs, _appended(F.col("history"), event)).otherwise(F.col("history"))
    cells = {"history": history, "status": F.when(differs, status).otherwise(F.col("status")), "status_reason": F.when(differs, reason).otherwise(F.col("status_reason"))}
    return state.select(*[cells.get(c, F.col(c)).alias(c) for c in state.columns])


def listed(state: DataFrame, status: str = "active", observation: str = "present", source: str | None = None, priority: str | None = None, site: str | None = None, limit: int = LIST) -> DataFrame:
    if not 1 <= limit <= MAX_LIST:
        raise ValueError(f"limit must be from 1 to {MAX_LIST}")
    rows = state
    if status != "all":
        rows = rows.where(F.col("status").isin("open", "planned") if status == "active" else F.col("status") == status)
    if observation != "all":
        rows = rows.where(F.col("observation_state") == observation)
    for c, v in (("source", source), ("priority", priority)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    if site is not None:
        rows = rows.where(normalized_site(F.col("site")) == normalized_site(F.lit(site)))
    order = [_rank(F.col("observation_state"), OBSERVATION_RANK), _rank(F.col("status"), STATUS_RANK), _rank(F.col("priority"), PRIORITY_RANK), F.desc("last_seen_at"), F.asc("id")]
    return rows.orderBy(*order).limit(limit)


def summary(state: DataFrame) -> DataFrame:
    """Counts by status and by observation, 0 where there are none: one row."""
    of = lambda c, values: [F.count_if(F.col(c) == v).alias(v) for v in values]
    return state.agg(F.count("*").alias("stored"), *of("status", STATUS_RANK), *of("observation_state", OBSERVATION_RANK))


class Conflict(RuntimeError):
    """Another writer holds the folder, or has replaced the version that this one began with."""


def _hadoop(spark: SparkSession, folder: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def locked(spark: SparkSession, folder: str) -> Iterator[None]:
    """One writer at a time: the lock is a file that only one can create. What it guards is a rename, so a lock older than LEASE_MS is left by a writer that died, and goes."""
    path, fs = _hadoop(spark, folder, LOCK)
    with contextlib.suppress(Py4JJavaError):  # there is none
        if fs.getFileStatus(path).getModificationTime() < time.time() * 1000 - LEASE_MS:
            fs.delete(path, False)
    try:
        fs.create(path, False).close()
    except Py4JJavaError as taken:
        raise Conflict(f"{folder} is locked") from taken
    try:
        yield
    finally:
        fs.delete(path, False)


def current_version(spark: SparkSession, folder: str) -> str | None:
    path, fs = _hadoop(spark, folder, POINTER)
    return spark.read.text(str(path.toString())).first()[0] if fs.exists(path) else None


#: For an unconditional write.
ANY = "*"


def write_version(state: DataFrame, folder: str, expected: str | None = ANY, keep: int = KEEP) -> str:
    """A new version beside the others; the pointer to it is replaced last, so readers see one or the other.

    expected: the version that state was made from (None: there was none); Conflict if it isn't the current one any more. The last
    ``keep`` versions stay, for readers that have begun.
    """
    spark, version = state.sparkSession, f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{version}")
    with locked(spark, folder):
        if expected != ANY and current_version(spark, folder) != expected:
            raise Conflict(f"{folder} has another version than {expected}")
        hadoop, context = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
        new, fs = _hadoop(spark, folder, f"{POINTER}-{version}")
        out = fs.create(new, True)
        out.write(version.encode())
        out.close()
        over = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(new.toUri(), context._jsc.hadoopConfiguration()).rename(new, hadoop.Path(f"{folder}/{POINTER}"), over)
        versions = sorted(f.getPath().getName() for f in fs.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("v-"))
        for old in versions[: versions.index(version)][: -(keep - 1) or None]:
            fs.delete(hadoop.Path(f"{folder}/{old}"), True)
    return version


def read_version(spark: SparkSession, folder: str, schema: str = STATE) -> DataFrame:
    version = current_version(spark, folder)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{folder}/{version}")


def pairs_to_compare(state: DataFrame, runs: DataFrame) -> DataFrame:
    """site, older, newer: each run that a stored opportunity was last seen in, against the site's new run."""
    return state.join(runs.select("site", F.col("run_id").alias("newer")), "site").select("site", F.col("latest_run_id").alias("older"), "newer").distinct().where("older <> newer")


def absent_verdicts(technical: DataFrame, search: DataFrame, search_pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Comparisons as verdicts for sync(). search_pairs: older, newer, comparable, complete."""
    t = technical.where("state IN ('resolved', 'unknown')").select("site", F.lit("technical").alias("source"), F.col("key").alias("comparison_key"), F.col("older").alias("latest_run_id"), F.col("state").alias("verdict"))
    gone = search.where("state = 'no_longer_observed'").select("site", F.col("key").alias("comparison_key"), F.col("older").alias("latest_run_id"), F.lit("gone").alias("_gone"))
    items = state.where("source <> 'technical'").select("site", "source", "comparison_key", "latest_run_id").join(search_pairs.select(F.col("older").alias("latest_run_id"), "comparable"), "latest_run_id")
    judged = items.join(gone, ["site", "comparison_key", "latest_run_id"], "left")
    s = judged.select("site", "source", "comparison_key", "latest_run_id", F.when(~F.col("comparable"), "incomparable").otherwise(F.coalesce("_gone", F.lit("unknown"))).alias("verdict"))
    return t.unionByName(s)
