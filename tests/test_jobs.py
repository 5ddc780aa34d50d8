"""Submissions and triggers, decided one after the other."""

import datetime as dt
import random

from loomgraph.operators import jobs
from loomgraph.operators.spells import spells

START = dt.datetime(2024, 1, 1)
JOBS = "job_id int, repo_id int, ts timestamp, status string"


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def refused(spark, rows):
    return sorted(r.job_id for r in jobs.refused(spark.createDataFrame([(i, repo, at(m), s) for i, repo, m, s in rows], JOBS)).collect())


def test_what_is_refused_refuses_nothing(spark):
    assert refused(spark, [(1, 1, 0, "running"), (2, 1, 8, "running"), (3, 1, 16, "running"), (4, 1, 24, "running")]) == [2, 4]
    # exactly when the job before ends; a job that is over at once; other repositories
    assert refused(spark, [(1, 1, 0, "running"), (2, 1, 10, "running"), (3, 2, 1, "done"), (4, 2, 2, "running"), (5, 2, 3, "done")]) == [5]


def test_odd_jobs(spark):
    rows = [(1, None, 0, "running"), (2, None, 5, "running"), (3, 1, None, "running"), (4, 1, 0, None), (5, 1, 1, "running"), (5, 1, 1, "running"), (6, 1, 2, "running")]
    assert refused(spark, rows) == [2, 5, 6] and refused(spark, []) == []


def test_against_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(4000), rng.choice(["running", "running", "done"])) for i in range(1500)]
    busy, want = {}, []
    for i, repo, m, status in sorted(rows, key=lambda r: (r[2], r[0])):
        if m < busy.get(repo, -1):
            want.append(i)
        elif status == "running":
            busy[repo] = m + 10
    assert refused(spark, rows) == sorted(want) and 100 < len(want) < 1400


def test_spells(spark):
    rows = [(k, us) for k in ("a", None) for us in (0, 9, 18, 28, 37, 100, 110, 119)]
    got = {(r.key, r.us): r.spell for r in spells(spark.createDataFrame(rows, "key string, us bigint"), 10).collect()}
    assert [got["a", us] for _, us in rows[:8]] == [got[None, us] for _, us in rows[:8]] == [1, 1, 1, 2, 2, 3, 4, 4]
