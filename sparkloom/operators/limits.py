"""Sliding-window limits in which only admitted requests count, over tables and over streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "event_id {kind}, allowed boolean, used int, remaining int, retry_after long, refused_by string"


class Limits:
    """Admissions of one tenant and its users; both scopes are asked before either is charged.

    Times are whole microseconds and never go back. A request exactly one window old doesn't count any more.
    """

    def __init__(self, per_user: int, per_tenant: int, seconds: int, tenant: list[int] | None = None):
        self.per_user, self.per_tenant, self.window = per_user, per_tenant, seconds * 1_000_000
        self.tenant = deque(tenant or ())
        self.users: dict[object, deque[int]] = {}

    def fresh(self, hits: deque[int], now: int) -> deque[int]:
        while hits and hits[0] <= now - self.window:
            hits.popleft()
        return hits

    def ask(self, user: object, now: int) -> tuple[bool, int, int, int, str | None]:
        """allowed, used and remaining in the tighter scope, seconds to wait, and the scope that refuses."""
        mine = self.fresh(self.users.setdefault(user, deque()), now)
        scopes = (("user", mine, self.per_user), ("tenant", self.fresh(self.tenant, now), self.per_tenant))
        for name, hits, limit in scopes:
            if len(hits) >= limit:
                wait = max(1, ceil((hits[0] + self.window - now) / 1_000_000))
                return False, len(hits), max(0, limit - len(hits)), wait, name
        for _, hits, _ in scopes:
            hits.append(now)
        used, limit = min(((len(h), n) for _, h, n in scopes), key=lambda x: x[1] - x[0])
        return True, used, limit - used, 0, None

    def forget(self, now: int) -> None:
        """Users without a hit in the window are no longer held."""
        for user in [u for u, hits in self.users.items() if not self.fresh(hits, now)]:
            del self.users[user]


def _micros(events: DataFrame) -> DataFrame:
    return events.select("tenant_id", "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def admissions(events: DataFrame, per_user: int, per_tenant: int, seconds: int = 60) -> DataFrame:
    """``event_id, allowed, used, remaining, retry_after, refused_by`` for a table ``tenant_id, user_id, event_id, ts``.

    Requests of a tenant are judged in the order of time and id. A refused request is charged to nobody, so it neither
    delays the next one nor drains the other scope. ``used`` and ``remaining`` are those of the tighter scope, or of the
    one that refuses; ``retry_after`` is when its oldest admitted request leaves the window. Null tenants are one
    tenant, null users one user of it. A tenant's requests pass through one task in batches, since each decision needs
    those before; what is held of them is bounded by the limits and the users of one window.
    """
    if min(per_user, per_tenant, seconds) < 1:
        raise ValueError("a limit admits at least one request in a positive window")
    kind = events.schema["event_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, limits, asked = object(), None, 0
        for batch in batches:
            out = []
            for who, user, now in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "user_id", "t")), strict=True):
                if limits is None or who != tenant:
                    tenant, limits = who, Limits(per_user, per_tenant, seconds)
                out.append(limits.ask(user, now))
                asked += 1
                if asked % 100_000 == 0:
                    limits.forget(now)
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["event_id", "allowed", "used", "remaining", "retry_after", "refused_by"])

    ordered = _micros(events).repartition("tenant_id").sortWithinPartitions("tenant_id", "t", "event_id")
    return ordered.mapInArrow(fold, DECISION.format(kind=kind))


class _Admit(StatefulProcessor):
    """A tenant's admitted requests as list state, its users' as map state; a timer drops what the watermark has passed."""

    def __init__(self, per_user: int, per_tenant: int, seconds: int):
        self.args = (per_user, per_tenant, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tenant = handle.getListState("tenant", "t long")
        self.users = handle.getMapState("users", "user string", "hits array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        limits = Limits(*self.args, [x[0] for x in self.tenant.get()] if self.tenant.exists() else None)
        out = []
        for row in some.itertuples(index=False):
            user = "" if row.user_id is None else f"={row.user_id}"
            if user not in limits.users:
                held = self.users.getValue((user,)) if self.users.exists() and self.users.containsKey((user,)) else None
                limits.users[user] = deque(held[0] if held else ())
            out.append((row.event_id, *limits.ask(user, int(row.t))))
        if limits.tenant:
            self.tenant.put([(x,) for x in limits.tenant])
        for user, hits in limits.users.items():
            if hits:
                self.users.updateValue((user,), (list(hits),))
        if not list(self.handle.listTimers()):
            self._wake(int(some["t"].max()))
        yield pd.DataFrame(out, columns=["event_id", "allowed", "used", "remaining", "retry_after", "refused_by"])

    def _wake(self, now: int) -> None:
        """Look again when the requests of now have left the window."""
        self.handle.registerTimer((now + self.args[2] * 1_000_000) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.args[2] * 1_000_000
        left = [x[0] for x in self.tenant.get() if x[0] > gone] if self.tenant.exists() else []
        if left:
            self.tenant.put([(x,) for x in left])
            for (user,), (hits,) in list(self.users.iterator()) if self.users.exists() else ():
                if not any(x > gone for x in hits):
                    self.users.removeKey((user,))
            self._wake(max(left))
        else:
            self.tenant.clear()
            self.users.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def admissions_stream(events: DataFrame, per_user: int, per_tenant: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """The same for a stream, whose state survives a restart from its checkpoint.

    Requests of one micro-batch are judged in the order of time and id; one that is later than the watermark (``late``)
    is dropped, undecided. A tenant's state goes once the watermark has passed its last request by a window, so it is
    bounded by the limits and by the users of the time that is still open. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = events.schema["event_id"].dataType.simpleString()
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.coalesce(F.col("tenant_id").cast("string"), F.lit("")).alias("tenant_id"), F.col("user_id").cast("string").alias("user_id"), "event_id", t.alias("t"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("tenant_id").transformWithStateInPandas(_Admit(per_user, per_tenant, seconds), outputStructType=DECISION.format(kind=kind), outputMode="Append", timeMode="EventTime")
