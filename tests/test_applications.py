"""Status replay against one action at a time."""

import datetime as dt
import random

import pytest

from postledger.operators import applications as apps, reports
from postledger.schemas import APPLICATIONS

T0 = dt.datetime(2024, 1, 1)


def replay(jobs, records, log):
    for job_id, via, status, notes, at, _ in sorted(log, key=lambda a: (a[4], a[5])):
        if job_id not in jobs:
            continue
        jobs[job_id]["status"] = status
        if via == "set_status" and status != "applied":
            records.pop(job_id, None)
        elif job_id in records:
            records[job_id].update(status=status, notes=notes, updated_at=at)
        else:
            records[job_id] = dict(
                job_id=job_id, company_id=jobs[job_id]["company_id"], position=jobs[job_id]["title"], status=status,
                applied_at=at, notes=notes, created_at=at, updated_at=at,
            )
    return jobs, records


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("share", [1000, 3])
def test_replay_matches_single_steps(spark, seed, share):
    rng = random.Random(seed)
    jobs = {i: dict(company_id=i % 4, title=f"t{i}", status="new") for i in range(12)}
    records = {
        i: dict(job_id=i, company_id=99, position="old", status="applied", applied_at=T0, notes="n", created_at=T0, updated_at=T0)
        for i in range(0, 12, 3)
    }
    log = []
    for pos in range(90):
        job = 1 if rng.random() < 0.4 else rng.randrange(14)
        via = rng.choice(["apply", "set_status", "set_status"])
        status = rng.choice(["applied", "new", "discarded", "interview"])
        log.append((job, via, status, rng.choice([None, f"n{pos}"]), T0 + dt.timedelta(hours=rng.randrange(1, 20)), pos))
    job_rows = spark.createDataFrame([(i, j["company_id"], j["title"], j["status"]) for i, j in jobs.items()], "id bigint, company_id bigint, title string, status string")
    old = spark.createDataFrame([tuple(r[n] for n in APPLICATIONS.names) for r in records.values()], APPLICATIONS)
    actions = spark.createDataFrame(log, "job_id bigint, via string, status string, notes string, at timestamp_ntz, pos bigint")
    done = apps.apply_actions(job_rows, old, actions, share)
    jobs, records = replay(jobs, records, log)
    assert {r.id: r.status for r in done.jobs.collect()} == {i: j["status"] for i, j in jobs.items()}
    assert {r.job_id: r.asDict() for r in done.applications.collect()} == records
    assert {r.job_id for r in done.rejects.collect()} <= {12, 13}


def test_views_and_validation(spark):
    jobs = spark.createDataFrame([(1, " Applied ", None), (2, "discarded", 2), (3, "x", 1), (4, None, 5)], "id int, status string, seen_count int")
    assert {r["view"]: r.n for r in reports.view_counts(jobs).collect()} == {"open": 2, "applied": 1, "discarded": 1, "total": 4}
    assert [(r.id, r.is_new) for r in reports.in_view(jobs, "applied").collect()] == [(1, True)]
    actions = spark.createDataFrame([(1, " NEW "), (2, "x"), (3, None)], "job_id int, status string")
    good, bad = apps.split_statuses(actions)
    assert [r.status for r in good.collect()] == ["new"] and bad.count() == 2
