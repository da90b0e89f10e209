"""The opportunity queue as keyed streaming state: one state variable an opportunity, one for the site's latest run.

``streaming.queue`` folds a batch by merges over the stored tables, as many as one site has runs in it. Here each run meets only the state of its own
site, in the state store: a batch costs what its runs hold, whatever is stored and however many runs a site has. A large site can be cut into
``parts`` keys by a hash of the opportunity; each part hears of every run, since what a run did not find changes, too.

Input: runs with what they found and what is said about the rest, as ``RUNS``. Output: for each run its opportunities' new rows, as in
``queue_state.STATE``, with their outcome; and a row with the outcome ``late`` for a run that completed before its site's latest one, or ``repeat`` for
that one itself. ``current`` makes the table of them. An event's time is its run's. A restart goes on from the checkpoint; ``stored`` begins from a
table instead.

Cases: a run that found nothing and says nothing makes all its site's opportunities unknown; null lists are empty; the same finding twice in a run counts once, with
the last in order of its fields; rows of one site in a batch are taken in the order of completion, then run_id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftline.functions.ship import ship
from siftline.operators import queue_state

FOUND = "struct<source:string,kind:string,comparison_key:string,priority:string>"
ABSENT = "struct<source:string,comparison_key:string,latest_run_id:string,verdict:string>"
RUNS = f"site string, run_id string, completed_at string, found array<{FOUND}>, absent array<{ABSENT}>"
CELLS = [c.strip().split(" ")[0] for c in queue_state.STATE.replace("\n", " ").partition("history")[0].rstrip(", ").split(",")]
#: An opportunity in the store: its cells, and its history as JSON.
ITEM = queue_state.STATE.partition("history")[0] + "history string"
OUT = f"site string, run_id string, completed_at string, outcome string, {ITEM.replace('id string, site string,', 'id string,', 1)}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _outcome(s: dict | None, found: bool, verdict: str) -> str:
    if s is None:
        return "created"
    if found:
        return "reopened" if s["status"] == "verified" else "updated"
    if verdict == "missing":
        return "unknown"
    if verdict == "resolved" and s["source"] == "technical":
        over = s["observation_state"] == "not_observed" and s["verified_at"] is not None and s["status"] in ("verified", "dismissed")
        return "unchanged" if over else "verified"
    if verdict == "gone":
        return "unchanged" if s["observation_state"] == "not_observed" else "not_observed"
    if s["source"] != "technical" and verdict == "unknown":
        return "unknown_quietly"
    return "unchanged" if s["observation_state"] == "unknown" else "unknown"


#: For each outcome: the event, the reason, and the observation that follows (None: none, none, as it was).
SAID = {
    "created": ("created", "first observed", "present"), "reopened": ("reopened", "observed again after it was verified", "present"), "updated": ("observed", "observed again", "present"),
    "verified": ("verified", "absent where it was looked for again", "not_observed"), "not_observed": ("not_observed", "absent from a comparable later period", "not_observed"),
    "unknown": ("observation_unknown", "no comparable evidence", "unknown"), "unknown_quietly": (None, None, "unknown"), "unchanged": (None, None, None),
}


def advanced(s: dict | None, d: dict | None, verdict: str, site: str, run: str, at: str) -> tuple[dict, str]:
    """An opportunity (s: as stored, d: as the run found it) after one run, and the outcome."""
    o = _outcome(s, d is not None, verdict)
    event, reason, observed = SAID[o]
    new = dict(s) if s else {**dict.fromkeys(CELLS), "site": site, "source": d["source"], "occurrences": 0, "first_seen_at": at, "status": "open", "history": []}
    before = s["status"] if s else None
    if d is not None:
        new |= {k: d[k] for k in ("kind", "priority", "comparison_key", "source") if d[k] is not None}
        new |= {"last_seen_at": at, "latest_run_id": run, "occurrences": new["occurrences"] + 1, "verified_older": None, "verified_newer": None, "verified_at": None}
    if o == "reopened":
        new |= {"status": "open", "status_reason": None}
    if o == "verified":
        new |= {"verified_older": s["latest_run_id"], "verified_newer": run, "verified_at": at}
        if s["status"] != "dismissed":
            new |= {"status": "verified", "status_reason": reason}
    if observed:
        new["observation_state"] = observed
    if event:
        said = {"at": at, "event": event, "run_id": run, "from_status": before, "to_status": new["status"], "reason": reason}
        new["history"] = [*new["history"], said][-queue_state.HISTORY :]
    return new, "unknown" if o == "unknown_quietly" else o


class Queue(StatefulProcessor):
    """Keyed by site and part: the latest synced run, and the opportunities by id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run_id string, completed_at string")
        self.items = handle.getMapState("items", "id string", ITEM.partition(", ")[2])

    def _read(self) -> dict[str, dict]:
        names = [*CELLS[1:], "history"]
        rows = {key[0]: dict(zip(names, value, strict=True)) for key, value in self.items.iterator()}
        return {i: r | {"history": json.loads(r["history"])} for i, r in rows.items()}

    def _put(self, i: str, item: dict) -> tuple:
        cells = (*[item[c] for c in CELLS[1:]], json.dumps(item["history"]))
        self.items.updateValue((i,), cells)
        return cells

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object = None) -> None:
        for r in initial.to_dict("records"):
            if r["id"] is None:
                self.last.update((r["latest_run_id"], r["last_seen_at"]))
            else:
                r = {k: None if v is None or v != v else v for k, v in r.items()}  # pandas' nulls
                self._put(r["id"], {**{c: r[c] for c in CELLS}, "occurrences": int(r["occurrences"]), "history": json.loads(r["history"])})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        site, out = key[0], []
        state = self._read()
        last = self.last.get() if self.last.exists() else None
        records = [r for part in rows for r in part.to_dict("records")]
        for r in sorted(records, key=lambda r: (r["completed_at"], r["run_id"])):
            run, at = r["run_id"], r["completed_at"]
            if last is not None and (last[0] == run or last[1] > at):
                out.append((site, run, at, "repeat" if last[0] == run else "late", *[None] * (len(CELLS))))
                continue
            last = (run, at)
            found = {f["id"]: f for f in sorted(map(dict, json.loads(r["found"])), key=lambda f: tuple(f[k] or "" for k in ("id", "source", "kind", "comparison_key", "priority")))}
            said = {(a["id"], a["latest_run_id"]): a["verdict"] for a in json.loads(r["absent"])}
            for i in sorted({*state, *found}):
                s = state.get(i)
                state[i], outcome = advanced(s, found.get(i), said.get((i, s and s["latest_run_id"]), "missing"), site, run, at)
                cells = self._put(i, state[i])
                out.append((site, run, at, outcome, i, *cells[1:]))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUT.replace("\n", " ").split(",")])

    def close(self) -> None:
        pass


def _keyed(runs: DataFrame, parts: int) -> DataFrame:
    """A row for each run and part, with the part's opportunities named by id."""
    ident = lambda x: queue_state.opportunity_id(F.col("site"), x.source, x.comparison_key)
    named = lambda c, fields: F.transform(F.coalesce(c, F.array().cast(runs.schema[c].dataType)), lambda x: F.struct(ident(x).alias("id"), *[x[f].alias(f) for f in fields]))
    own = lambda c: F.to_json(F.filter(c, lambda x: F.pmod(F.xxhash64(x.id), F.lit(parts)) == F.col("part")), {"ignoreNullFields": "false"})
    rows = runs.withColumns({"found": named("found", ("source", "kind", "comparison_key", "priority")), "absent": named("absent", ("source", "comparison_key", "latest_run_id", "verdict"))})
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return rows.select("site", "part", "run_id", "completed_at", own("found").alias("found"), own("absent").alias("absent"))


def _stored(state: DataFrame, syncs: DataFrame, parts: int) -> DataFrame:
    """state and syncs as rows of ITEM with their part; a site's latest run is a row without an id in each part."""
    items = state.select(*CELLS, F.to_json("history", {"ignoreNullFields": "false"}).alias("history"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    cells = {c: F.lit(None).cast(items.schema[c].dataType) for c in [*CELLS, "history"]} | {"site": F.col("site"), "latest_run_id": F.col("latest_run_id"), "last_seen_at": F.col("completed_at")}
    last = syncs.select(*[v.alias(c) for c, v in cells.items()], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return items.unionByName(last)


def outcomes(runs: DataFrame, parts: int = 1, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A stream of RUNS -> rows of OUT. stored: state and syncs to begin from, where there is no checkpoint yet. Sets the session's state store to RocksDB."""
    spark = runs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # keyed state has no other
    initial = _stored(*stored, parts).groupBy("site", "part") if stored else None
    return _keyed(runs, parts).groupBy("site", "part").transformWithStateInPandas(Queue(), OUT, "Update", "None", initial)


def current(rows: DataFrame) -> DataFrame:
    """All rows of OUT so far -> the queue as it is now, as queue_state.STATE."""
    newest = Window.partitionBy("id").orderBy(F.desc("completed_at"), F.desc("run_id"))
    last = rows.where("id IS NOT NULL").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return last.select(*CELLS, F.from_json("history", f"array<{queue_state.EVENT}>").alias("history"))
