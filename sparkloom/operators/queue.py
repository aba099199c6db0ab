"""A leased job queue as a fold over its log: what each job came to, and which calls were refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages in order, errors that no further attempt can mend, seconds of a lease, of the first and the
# longest wait after a failure, and attempts.
STAGES = ["FETCHED", "PARSED", "CHUNKED", "CONTEXTUALIZED", "EMBEDDED", "INDEXED", "ACTIVATED"]
PERMANENT = ["unsupported_format", "encrypted_document", "corrupt_document", "document_too_large", "mapping_rejected", "tenant_deleted", "blob_missing"]
LEASE, FIRST_WAIT, LONGEST_WAIT, ATTEMPTS = 600, 2, 600, 5
STATE = "struct<status:string,worker:string,lease_until:bigint,run_after:bigint,attempts:bigint,stage:string,code:string,n_claims:bigint,n_refused:bigint,n_lost:bigint>"


def wait(job: Column, attempts: Column) -> Column:
    """Seconds before the next attempt: anywhere up to a limit that doubles, settled by the job and the attempt alone."""
    longest = F.least(F.lit(float(LONGEST_WAIT)), FIRST_WAIT * F.pow(F.lit(2.0), attempts - 1))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", job.cast("string"), attempts.cast("string"))), 1, 4), 16, 10).cast("long") / 65536
    return F.floor(longest * part).cast("long")


def _after(job: Column, s: Column, e: Column, lease: int, attempts: int) -> Column:
    """The state after one call. Only the worker that holds a job may report on it."""
    action, t = e["action"], e["t"]
    running = s["status"] == "RUNNING"
    mine = running & (s["worker"] == e["worker"])
    claimed = (action == "claim") & (s["status"] == "QUEUED") & (s["run_after"] <= t)
    beat, told, completed = mine & (action == "heartbeat"), mine & (action == "checkpoint"), mine & (action == "complete")
    failed = mine & (action == "fail")
    dead = failed & (F.coalesce(e["detail"].isin(PERMANENT), F.lit(False)) | (s["attempts"] >= attempts))
    again = failed & ~dead
    reclaimed = (action == "reclaim") & running & (s["lease_until"] < t)
    reports = action.isin("heartbeat", "checkpoint", "complete", "fail")
    n = s["attempts"] + F.when(claimed, 1).otherwise(0)
    free = completed | failed | reclaimed
    return F.struct(
        F.when(claimed, "RUNNING").when(completed, "DONE").when(dead, "DEAD").when(again | reclaimed, "QUEUED").otherwise(s["status"]).alias("status"),
        F.when(claimed, e["worker"]).when(again | reclaimed, F.lit(None)).otherwise(s["worker"]).alias("worker"),
        F.when(claimed | beat, t + lease).when(free, F.lit(None)).otherwise(s["lease_until"]).alias("lease_until"),
        F.when(again, t + wait(job, s["attempts"])).when(reclaimed, t).otherwise(s["run_after"]).alias("run_after"),
        n.alias("attempts"),
        F.when(told, e["detail"]).when(completed, F.lit(STAGES[-1])).otherwise(s["stage"]).alias("stage"),
        F.when(failed, e["detail"]).when(completed, F.lit(None)).otherwise(s["code"]).alias("code"),
        (s["n_claims"] + F.when(claimed, 1).otherwise(0)).alias("n_claims"),
        (s["n_refused"] + F.when((action == "claim") & ~claimed, 1).otherwise(0)).alias("n_refused"),
        (s["n_lost"] + F.when(reports & ~F.coalesce(mine, F.lit(False)), 1).otherwise(0)).alias("n_lost"),
    ).cast(STATE)


def replay(log: DataFrame, lease: int = LEASE, attempts: int = ATTEMPTS) -> DataFrame:
    """``job_id`` and its state after all calls: status, worker, lease, attempts, stage, code, and counts of calls.

    log: ``job_id, seq, t (seconds), action, worker, detail``. Calls count in the order of t and seq. ``claim`` takes a
    queued job whose time has come, for ``lease`` seconds, and is refused otherwise, so no job is held twice;
    ``heartbeat`` renews the lease; ``checkpoint`` notes a stage; ``complete`` ends a job; ``fail`` sends it back after
    a wait, or, with a permanent code or after ``attempts`` attempts, to the dead letters; ``reclaim`` takes a job back
    whose lease has run out, its attempt counted. Reports by another worker than the one that holds the job change
    nothing and are counted as lost. Unknown actions change nothing. One job's calls are folded in one row; jobs are
    spread over tasks.
    """
    start = F.struct(F.lit("QUEUED"), F.lit(None), F.lit(None), F.lit(-(1 << 62)), F.lit(0), F.lit(None), F.lit(None), F.lit(0), F.lit(0), F.lit(0)).cast(STATE)
    calls = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "action", "worker", "detail"))).alias("calls"))
    done = calls.select("job_id", F.aggregate("calls", start, lambda s, e: _after(F.col("job_id"), s, e, lease, attempts)).alias("s")).select("job_id", "s.*")
    return done.withColumn("run_after", F.when(F.col("run_after") > -(1 << 62), F.col("run_after")))


def expired(jobs: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The next ``limit`` running jobs whose lease has run out, longest first: one bounded batch of a sweep."""
    return jobs.where((F.col("status") == "RUNNING") & (F.col("lease_until") < now)).orderBy("lease_until", "job_id").limit(limit)


def remaining(stage: Column) -> Column:
    """Stages that a job still has to go through; all of them before the first, or after one that is unknown."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)).cast("int")
    return F.slice(F.array(*[F.lit(s) for s in STAGES]), at + 1, len(STAGES))
