"""Keyed state gives what the merges give: random runs in random batches, restarts and a stored beginning included."""

import random

import pytest
from siftline.operators import queue_state
from siftline.streaming import keyed_queue


def random_runs(seed, sites=3, runs=7, keys=4):
    rng = random.Random(seed)
    out = []
    for s in range(sites):
        for n in range(runs):
            found = [(rng.choice(["technical", "technical", "search"]), "k", f"c{k}", rng.choice(["high", "low"])) for k in range(keys) if rng.random() < 0.5]
            absent = [(source, f"c{k}", f"s{s}r{m}", rng.choice(["resolved", "unknown", "gone", "incomparable"])) for source in ("technical", "search") for k in range(keys) for m in range(runs) if rng.random() < 0.6]
            out.append((f"s{s}", f"s{s}r{n}", f"t{n // 2 if rng.random() < 0.2 else n}", found, absent))
    rng.shuffle(out)
    return out


def by_merges(spark, batches):
    """Each run by itself through queue_state.sync, sites one after the other."""
    state, syncs, late = spark.createDataFrame([], queue_state.STATE), spark.createDataFrame([], queue_state.SYNCS), []
    names = {"d": "site string, source string, kind string, comparison_key string, priority string", "a": "site string, source string, comparison_key string, latest_run_id string, verdict string", "r": "site string, run_id string, completed_at string"}
    latest = {}
    for batch in batches:
        for site, run, at, found, absent in sorted(batch, key=lambda r: (r[0], r[2], r[1])):
            if site in latest and (latest[site][0] == run or latest[site][1] > at):
                late.append((run, "repeat" if latest[site][0] == run else "late"))
                continue
            latest[site] = (run, at)
            rows = {"d": [(site, *f) for f in found], "a": [(site, *a) for a in absent], "r": [(site, run, at)]}
            frames = {k: spark.createDataFrame(v, names[k]) for k, v in rows.items()}
            state, syncs, _ = queue_state.sync(state, syncs, frames["r"], frames["d"], frames["a"], at)
            state, syncs = spark.createDataFrame(state.collect(), queue_state.STATE), spark.createDataFrame(syncs.collect(), queue_state.SYNCS)
    return state, syncs, sorted(late)


def plain(state):
    return sorted((tuple(map(str, r)) for r in state.select(*keyed_queue.CELLS, "history").collect()))


def stream(spark, tmp, batches, parts, stored=None, name="q"):
    source, out = tmp / f"{name}-in", f"file://{tmp}/{name}-out"
    for n, batch in enumerate(batches):  # each batch is a run of the query of its own: a restart
        spark.createDataFrame(batch, keyed_queue.RUNS).coalesce(1).write.mode("append").json(str(source))
        rows = keyed_queue.outcomes(spark.readStream.schema(keyed_queue.RUNS).json(str(source)), parts, stored)
        write = lambda df, k, n=n: df.write.mode("overwrite").parquet(f"{out}/start={n}/batch={k}")
        rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp}/{name}-c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("start", "batch")


def test_random_orders_and_restarts(spark, tmp_path):
    runs = random_runs(1, sites=2, runs=5)
    batches = [runs[:4], runs[4:8] + runs[:1], runs[8:]]
    state, _, late = by_merges(spark, batches)
    rows = stream(spark, tmp_path, batches, 2)
    assert plain(keyed_queue.current(rows)) == plain(state)
    refused = sorted((r.run_id, r.outcome) for r in rows.where("id IS NULL").distinct().collect())
    assert refused == sorted(set(late)) and late


def test_from_a_stored_queue(spark, tmp_path):
    runs = sorted(random_runs(2, sites=2, runs=4), key=lambda r: r[2])
    state, syncs, _ = by_merges(spark, [runs[:4]])
    rows = stream(spark, tmp_path, [runs[4:]], 1, (state, syncs))
    want, _, _ = by_merges(spark, [runs[:4], runs[4:]])
    touched = {r.id for r in rows.collect()}
    assert plain(keyed_queue.current(rows)) == [x for x in plain(want) if x[0] in touched] and touched


@pytest.mark.parametrize("seed", range(30))
def test_steps(seed):
    """History is bounded, occurrences count runs, and an opportunity that isn't touched stays."""
    rng, item = random.Random(seed), None
    seen = 0
    for n in range(130):
        d = {"source": "technical", "kind": "k", "comparison_key": "c", "priority": "high"} if item is None or rng.random() < 0.5 else None
        seen += d is not None
        item, outcome = keyed_queue.advanced(item, d, rng.choice(["missing", "resolved", "gone", "unknown"]), "s", f"r{n}", f"{n:03}")
        assert item["occurrences"] == seen and len(item["history"]) <= queue_state.HISTORY
        assert (item["verified_at"] is not None) <= (item["observation_state"] != "present")
