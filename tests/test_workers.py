"""Slots, budget and the stream of workers against plain loops, and a restart in the middle."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from trawl.operators import crawl as C
from trawl.streaming import workers as WK


def made(n, seed, sites=("a", "b", None)):
    rng = random.Random(seed)
    now, out = 0, []
    for i in range(n):
        now += rng.choice([0, 1, 3, 50, 400])
        out.append((rng.randrange(10**9) * 1000 + i, rng.choice(sites), f"u{rng.randrange(12)}", now, rng.choice([0, 5, 20])))
    return out


def by_loop(rows, idle):
    """(entries, ended rows that a later entry proves) of rows (event_id, site, url, arrival, delay)."""
    state, times, out, ended = {}, {}, [], []
    for event_id, site, url, arrival, delay in sorted(rows, key=lambda r: (r[3], r[0])):
        free, last, worker = state.get(site, (0, None, 0))
        if last is not None and arrival - last > idle:
            ended.append(("ended", site, None, None, None, worker, last + idle))
            worker += 1
        start = max(arrival, free)
        out.append(("entry", site, event_id, url, times.get((site, url), 0), worker, start))
        times[site, url] = times.get((site, url), 0) + 1
        state[site] = (start + delay, arrival, worker)
    return out, ended


def test_slots_equal_a_loop(spark):
    rows = made(400, 1)
    df = spark.createDataFrame(rows, WK.REQUESTS)
    for width in (7, 10**9):
        got = C.slot_schedule(df, "site", "arrival", "event_id", "delay", F.floor(F.col("arrival") / width))
        assert sorted((r["event_id"], r["start"]) for r in got.collect()) == sorted((r[2], r[6]) for r in by_loop(rows, 10**9)[0])
    assert C.slot_schedule(df.limit(0), "site", "arrival", "event_id", "delay", F.floor(F.col("arrival") / 7)).count() == 0


def test_budget_overshoots_by_the_workers(spark):
    rng = random.Random(4)
    pages = [(i, rng.randrange(3)) for i in range(60)]
    for budget in (0, 10, 58, 100):
        count, ended, done = 0, set(), []
        for i, worker in pages:
            if worker not in ended:
                done.append(i)
                if count >= budget:
                    ended.add(worker)
                else:
                    count += 1
        got = C.within_budget(spark.createDataFrame(pages, "id long, worker int"), ["id"], budget, F.floor(F.col("id") / 9))
        assert sorted(r["id"] for r in got.collect()) == done and len(done) <= budget + 3


def entries(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    idle, rows = 300, [(i, s, u, t * 1000, d * 1000) for i, s, u, t, d in made(160, 7, ("a", "b", "c"))]
    idle *= 1000
    df = spark.createDataFrame(rows, WK.REQUESTS)
    middle = sorted(r[3] for r in rows)[90]
    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    WK.write_in_order(df, f"{once}/source", "arrival", 4)
    whole = entries(WK.run(spark, f"{once}/source", f"{once}/table", f"{once}/checkpoint", idle))

    WK.write_in_order(df.filter(F.col("arrival") < middle), f"{twice}/source", "arrival", 2)
    WK.run(spark, f"{twice}/source", f"{twice}/table", f"{twice}/checkpoint", idle)
    WK.write_in_order(df.filter(F.col("arrival") >= middle), f"{twice}/source", "arrival", 2)
    again = entries(WK.run(spark, f"{twice}/source", f"{twice}/table", f"{twice}/checkpoint", idle))
    expected, ended = by_loop(rows, idle)
    assert [r for r in whole if r[0] == "entry"] == [r for r in again if r[0] == "entry"] == sorted(expected, key=repr)
    # a worker that is idle at the end has ended too where the watermark has passed
    last = max(r[3] for r in rows) // 1000
    final = {}
    for r in sorted(rows, key=lambda r: r[3]):
        final[r[1]] = r[3]
    workers = {r[1]: r[5] for r in expected}
    ended += [("ended", s, None, None, None, workers[s], t + idle) for s, t in final.items() if (t + idle) // 1000 + 1 <= last]
    assert [r for r in whole if r[0] == "ended"] == [r for r in again if r[0] == "ended"] == sorted(ended, key=repr)
    # nothing new changes nothing
    assert entries(WK.run(spark, f"{twice}/source", f"{twice}/table", f"{twice}/checkpoint", idle)) == again


class Kept:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def registerTimer(self, at):
        pass

    def deleteTimer(self, at):
        pass


def test_state_is_asked_once_a_url_and_batch():
    rows = sorted(made(3000, 3, ("a",)), key=lambda r: (r[3], r[0]))
    worker, got = WK.Workers(300), []
    worker.handle, worker.site, worker.found = Kept(), Kept(), Kept()
    for at in range(0, len(rows), 500):
        batch = pd.DataFrame(rows[at : at + 500], columns=["event_id", "site", "url", "arrival", "delay"])
        for frame in worker.handleInputRows(("a",), iter([batch[:200], batch[200:]]), None):
            got += [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)]
    expected, ended = by_loop(rows, 300)
    assert sorted(got, key=repr) == sorted(expected + ended, key=repr) and ended
    assert worker.found.calls <= 3 * 12 * -(-len(rows) // 500)
