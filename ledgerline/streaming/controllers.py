"""Keyed state machines over ordered events: token bucket, circuit breaker, degradation, patch control.

Each is a small step function of (state, event); Spark sorts and groups the events of a key, and the steps run over one key's events in
batches that keep the state, so a key may have any number of events. The same steps serve streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, is_dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.registry import query
from ledgerline.sources.ledger import Ledger


def folded(df: DataFrame, by: str, order: list[str], step: Callable, start: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, output) over each key's rows in order; one output a row. Keys are dealt by hash, sorted, and read as a stream."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (now := getattr(row, by)) != key:
                    key, state = now, start()
                state, result = step(state, row)
                out.append(result)
            if out:
                yield pd.DataFrame(out)

    return df.select(*columns).repartition(F.col(by)).sortWithinPartitions(by, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Bucket:
    tokens: float = 20.0
    at: float | None = None
    paused_until: float = 0.0


def take_token(b: Bucket, now: float, rate: float = 10.0, burst: float = 20.0, cost: float = 1.0) -> tuple[Bucket, bool, float]:
    """The bucket after a request, whether it may go, and how long it should wait otherwise."""
    if now < b.paused_until:
        return b, False, b.paused_until - now
    tokens = burst if b.at is None else min(burst, b.tokens + max(0.0, now - b.at) * rate)
    if tokens >= cost:
        return replace(b, tokens=tokens - cost, at=now), True, 0.0
    return replace(b, tokens=tokens, at=now), False, (cost - tokens) / rate


def rate_limited(requests: DataFrame, rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """requests (request_id, instance, at in seconds) with allowed and wait_seconds, instance by instance in order of time."""

    def step(b, row):
        b, allowed, wait = take_token(b, row.at, rate, burst)
        return b, {"request_id": row.request_id, "instance": row.instance, "allowed": allowed, "wait_seconds": wait}

    return folded(requests.select("request_id", "instance", "at"), "instance", ["at", "request_id"], step, lambda: Bucket(tokens=burst), "request_id long, instance string, allowed boolean, wait_seconds double")


@dataclass(frozen=True)
class BreakerConfig:
    """Fixed values of the ledger's circuit breaker."""

    failure: float = 0.3
    rate_limit: float = 0.2
    timeout: float = 0.2
    min_samples: int = 5
    open_seconds: float = 300.0
    successes_to_close: int = 2
    max_probes: int = 3
    alpha: float = 0.5
    degraded_batch: int = 10
    full_batch: int = 100
    degraded_window: int = 300
    backfill_seconds: float = 600.0
    backfill_only: bool = True
    probe_budget: int = 2
    probe_types: tuple[str, ...] = ("commits",)


@dataclass(frozen=True)
class Breaker:
    state: str = "closed"
    opened_at: float = 0.0
    successes: int = 0
    probes: int = 0
    failed: float | None = None
    limited: float | None = None
    timed_out: float | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Decision:
    """What a breaker lets a sync do."""

    allow_sync: bool = True
    backfill_only: bool = False
    batch: int | None = None
    window: int | None = None
    diff_mode: str | None = None
    wait_seconds: float = 0.0
    probe: bool = False
    probe_budget: int = 0
    probe_types: tuple[str, ...] = ()


def smoothed(now: float, before: float | None, c: BreakerConfig = BreakerConfig()) -> float:
    a = max(0.01, min(1.0, c.alpha))
    return now if before is None else a * now + (1.0 - a) * before


def breaker_check(b: Breaker, now: float, failed: float, limited: float, timed_out: float, samples: int, c: BreakerConfig = BreakerConfig()) -> tuple[Breaker, Decision]:
    """Before a sync. A closed breaker smooths the three rates, given enough samples, and opens on the first that is too high; an open one lets
    probes go after its time; a half open one opens again when its probes are used up without enough successes."""
    less = Decision(allow_sync=c.backfill_only, backfill_only=True, batch=c.degraded_batch, window=c.degraded_window, diff_mode="none")
    probing = replace(less, allow_sync=True, probe=True, probe_budget=c.probe_budget, probe_types=c.probe_types)
    if b.state == "closed":
        if samples < c.min_samples:
            return b, Decision()
        b = replace(b, failed=smoothed(failed, b.failed, c), limited=smoothed(limited, b.limited, c), timed_out=smoothed(timed_out, b.timed_out, c))
        for name, rate, most in (("failure_rate", b.failed, c.failure), ("rate_limit_rate", b.limited, c.rate_limit), ("timeout_rate", b.timed_out, c.timeout)):
            if rate >= most:
                return replace(b, state="open", opened_at=now, reason=name, successes=0, probes=0), replace(less, wait_seconds=c.backfill_seconds)
        return b, Decision()
    if b.state == "open":
        left = c.open_seconds - (now - b.opened_at)
        return (replace(b, state="half_open", successes=0, probes=0), probing) if left <= 0 else (b, replace(less, wait_seconds=left))
    if b.probes >= c.max_probes and b.successes < c.successes_to_close:
        return replace(b, state="open", opened_at=now), replace(less, wait_seconds=c.open_seconds)
    return b, replace(probing, batch=recovery_batch(b.successes, c), backfill_only=b.successes < 1, diff_mode="best_effort" if b.successes else "none")


def recovery_batch(successes: int, c: BreakerConfig = BreakerConfig()) -> int:
    """The batch size of a half-open breaker: from the degraded one to the full one."""
    return int(c.degraded_batch + (c.full_batch - c.degraded_batch) * min(1.0, (successes + 1) / c.successes_to_close))


def breaker_result(b: Breaker, now: float, ok: bool, c: BreakerConfig = BreakerConfig()) -> Breaker:
    """After a sync; only a half open breaker asks: it closes after enough successes and opens on a failure."""
    if b.state != "half_open":
        return b
    if not ok:
        return replace(b, state="open", opened_at=now, successes=0, probes=b.probes + 1, reason="half_open_probe_failed")
    if b.successes + 1 >= c.successes_to_close:
        return replace(b, state="closed", opened_at=0.0, successes=0, probes=0, reason=None)
    return replace(b, successes=b.successes + 1, probes=b.probes + 1)


BREAKER_ROW = "id long, key string, allow_sync boolean, backfill_only boolean, batch int, window int, diff_mode string, wait_seconds double, probe boolean, state string, reason string, failed double, limited double"


def _breaker_row(b: Breaker, row) -> tuple[Breaker, dict]:
    b, d = breaker_check(b, row.at, row.failed_rate, row.limited_rate, row.timeout_rate, int(row.n))
    b = breaker_result(b, row.at, bool(row.ok))
    said = {"allow_sync": d.allow_sync, "backfill_only": d.backfill_only, "batch": d.batch, "window": d.window, "diff_mode": d.diff_mode, "wait_seconds": d.wait_seconds, "probe": d.probe}
    return b, {"id": row.id, "key": row.key, **said, "state": b.state, "reason": b.reason, "failed": b.failed, "limited": b.limited}


def breaker_states(samples: DataFrame) -> DataFrame:
    """samples (id, key, at, failed_rate, limited_rate, timeout_rate, n, ok) with what the breaker lets each do, and its state after the sync's result ok."""
    return folded(samples.select("id", "key", "at", "failed_rate", "limited_rate", "timeout_rate", "n", "ok"), "key", ["at", "id"], _breaker_row, Breaker, BREAKER_ROW)


@dataclass(frozen=True)
class DegradationConfig:
    """Fixed values of the ledger's degradation."""

    min_batch: int = 10
    full_batch: int = 100
    batch_shrink: float = 0.5
    batch_grow: float = 1.2
    min_window: int = 300
    full_window: int = 3600
    window_shrink: float = 0.5
    window_grow: float = 1.5
    rate_limits: int = 3
    timeouts: int = 3
    too_large: int = 5
    base_sleep: float = 1.0
    longest_sleep: float = 300.0
    successes: int = 5


@dataclass(frozen=True)
class Degradation:
    """How hard a sync runs, and the errors in a row that led there."""

    diff_mode: str = "best_effort"
    batch: int = 100
    window: int = 3600
    paused: bool = False
    sleep: float = 0.0
    hits: int = 0
    timeouts: int = 0
    server_errors: int = 0
    too_large: int = 0
    streak: int = 0


def degradation_step(d: Degradation, hits: int, timeouts: int, server_errors: int, too_large: int, succeeded: bool, retry_after: float | None = None, unknown: int = 0, c: DegradationConfig = DegradationConfig()) -> Degradation:
    """The settings after a round. Counts of errors in a row add the round's, and end with a round that succeeded without that kind; the streak of
    successes ends with an error of any kind. Only the mode none recovers, to best_effort; a pause makes the sleep as long as itself."""
    grown = lambda old, new: old + new if new else (0 if succeeded else old)
    clean = not (hits or timeouts or server_errors or too_large or unknown)
    d = replace(d, hits=grown(d.hits, hits), timeouts=grown(d.timeouts, timeouts), server_errors=grown(d.server_errors, server_errors), too_large=grown(d.too_large, too_large), streak=d.streak + 1 if clean and succeeded else 0)
    recovered = d.streak >= c.successes
    mode = "none" if d.hits >= c.rate_limits or d.too_large >= c.too_large else d.diff_mode
    mode = "best_effort" if mode == "none" and recovered else mode
    batch = max(c.min_batch, int(d.batch * c.batch_shrink)) if hits or timeouts else min(c.full_batch, int(d.batch * c.batch_grow)) if recovered and d.batch < c.full_batch else d.batch
    window = max(c.min_window, int(d.window * c.window_shrink)) if hits else min(c.full_window, int(d.window * c.window_grow)) if recovered and d.window < c.full_window else d.window
    sleep = min(retry_after, c.longest_sleep) if retry_after and retry_after > 0 else min(c.base_sleep * 2.0 ** (d.hits - 1), c.longest_sleep) if d.hits else 0.0
    paused = d.timeouts >= c.timeouts or d.server_errors >= c.timeouts
    if paused:
        sleep = max(sleep, min(c.base_sleep * 2.0**d.timeouts, c.longest_sleep))
    return replace(d, diff_mode=mode, batch=batch, window=window, sleep=sleep, paused=paused)


def degraded(rounds: DataFrame) -> DataFrame:
    """rounds (id, key, at, hits, timeouts, server_errors, too_large, unknown, succeeded) with the settings after each."""

    def step(d, row):
        d = degradation_step(d, int(row.hits), int(row.timeouts), int(row.server_errors), int(row.too_large), bool(row.succeeded), unknown=int(row.unknown))
        return d, {"id": row.id, "key": row.key, "diff_mode": d.diff_mode, "batch": d.batch, "window": d.window, "sleep": d.sleep, "paused": d.paused}

    return folded(rounds.select("id", "key", "at", "hits", "timeouts", "server_errors", "too_large", "unknown", "succeeded"), "key", ["at", "id"], step, Degradation, "id long, key string, diff_mode string, batch int, window int, sleep double, paused boolean")


@dataclass(frozen=True)
class Patches:
    timeouts: int = 0
    too_large: int = 0
    skip: bool = False
    reason: str | None = None


#: Fixed values of the ledger's contract: errors in a row from which patches are skipped.
PATCH_LIMITS = {"timeout": 3, "content_too_large": 5}


def patch_step(p: Patches, category: str | None) -> Patches:
    """Patches after a fetch: no category is a success and starts anew; a timeout ends a row of too large contents and the other way round; other errors count for neither."""
    if category is None:
        return Patches()
    if category == "timeout":
        p = replace(p, timeouts=p.timeouts + 1, too_large=0)
    elif category == "content_too_large":
        p = replace(p, too_large=p.too_large + 1, timeouts=0)
    for name, n in (("timeout", p.timeouts), ("content_too_large", p.too_large)):
        if category == name and n >= PATCH_LIMITS[name]:
            return replace(p, skip=True, reason=f"consecutive_{name}={n}>=threshold={PATCH_LIMITS[name]}")
    return p


def _skip_row(p: Patches, row) -> tuple[Patches, dict]:
    p = patch_step(p, row.category if isinstance(row.category, str) else None)
    return p, {"id": row.id, "key": row.key, "skip": p.skip, "reason": p.reason}


def patch_skips(rounds: DataFrame) -> DataFrame:
    """rounds (id, key, at, category; null for a success) with whether patches are skipped after each, and why."""
    return folded(rounds.select("id", "key", "at", "category"), "key", ["at", "id"], _skip_row, Patches, "id long, key string, skip boolean, reason string")


def next_window(width: int, limited: bool, low: int = 300, high: int = 86400, shrink: float = 0.5, grow: float = 1.5) -> int:
    """An adaptive window after a fetch."""
    return int(min(high, max(low, width * (shrink if limited else grow))))


def folded_stream(stream: DataFrame, by: str, step: Callable, start: Callable, revive: Callable, order: list[str], schema: str) -> DataFrame:
    """folded() for a stream: each batch's rows of a key in order, after those of earlier batches. A key's state is kept as JSON; revive turns that back.

    A task holds the rows that one key has in one batch, as they must be put in order: the source's limit of a batch (maxFilesPerTrigger and the like) bounds them.
    """

    def run(key, batches, held):
        state = revive(json.loads(held.get[0])) if held.exists else start()
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in rows.itertuples(index=False):
            state, result = step(state, row)
            out.append(result)
        held.update((json.dumps(asdict(state) if is_dataclass(state) else state),))
        yield pd.DataFrame(out)

    return stream.groupBy(by).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def breaker_stream(stream: DataFrame) -> DataFrame:
    """breaker_states for a stream of the same columns."""
    return folded_stream(stream, "key", _breaker_row, Breaker, lambda d: Breaker(**d), ["at", "id"], BREAKER_ROW)


def patch_skip_stream(stream: DataFrame) -> DataFrame:
    """patch_skips for a stream (id, key, category)."""
    return folded_stream(stream, "key", _skip_row, Patches, lambda d: Patches(**d), ["id"], "id long, key string, skip boolean, reason string")


def _rounds(db: Ledger) -> DataFrame:
    e = db._events()
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), (F.unix_micros("ts") / F.lit(1_000_000.0)).alias("at"), F.col("event_type"), F.col("k"))


#: Rounds of a key, numbered, for the recursive SQL that follows them one by one.
_ROUNDS = "WITH RECURSIVE r AS (SELECT event_id AS id, user_id::varchar AS key, epoch_us(ts) / 1000000.0::double AS tm, event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),"


@query("rate_limited_requests", _ROUNDS + """
f AS (SELECT id, key, rn, tm / 3600 AS last, CASE WHEN 3.0 >= 1 THEN 2.0::double ELSE 3.0 END AS tokens, true AS allowed, 0.0::double AS wait_seconds FROM r WHERE rn = 1
  UNION ALL SELECT id, key, rn, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1, CASE WHEN have >= 1 THEN 0.0::double ELSE (1.0 - have) / 0.05::double END
  FROM (SELECT r.id, r.key, r.rn, r.tm / 3600 AS t, least(3.0::double, f.tokens + greatest(0.0::double, r.tm / 3600 - f.last) * 0.05::double) AS have FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1))
SELECT id AS request_id, key AS instance, allowed, wait_seconds FROM f""")
def _limited(db: Ledger):
    return rate_limited(_rounds(db).select(F.col("id").alias("request_id"), F.col("key").alias("instance"), (F.col("at") / 3600).alias("at")), rate=0.05, burst=3.0)


#: The breaker in SQL: a check of the state before (o), then the sync's result.
_BREAKER = """
s AS (SELECT id, key, rn, tm, CASE WHEN event_type = 'error' THEN 1.0::double ELSE 0.0 END AS fr, CASE WHEN k % 10 = 0 THEN 0.5::double ELSE 0.0 END AS lr, CASE WHEN k % 13 = 0 THEN 0.4::double ELSE 0.0 END AS tr, 3 + k % 7 AS n, event_type <> 'error' AS ok FROM r),
f AS (SELECT NULL::bigint AS id, key, 0::bigint AS rn, 'closed' AS state, 0.0::double AS opened, 0 AS wins, 0 AS tries, NULL::double AS ef, NULL::double AS el, NULL::double AS et, NULL::varchar AS reason, true AS allow_sync, false AS backfill_only, NULL::int AS batch, NULL::int AS win, NULL::varchar AS diff_mode, 0.0::double AS wait_seconds, false AS probe FROM (SELECT DISTINCT key FROM s)
  UNION ALL
  SELECT id, key, rn, CASE WHEN c = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN wins + 1 >= 2 THEN 'closed' ELSE 'half_open' END ELSE c END,
    CASE WHEN c = 'half_open' AND NOT ok THEN tm WHEN c = 'half_open' AND wins + 1 >= 2 THEN 0.0 ELSE opened END,
    CASE WHEN c <> 'half_open' THEN wins WHEN NOT ok OR wins + 1 >= 2 THEN 0 ELSE wins + 1 END, CASE WHEN c <> 'half_open' THEN tries WHEN ok AND wins + 1 >= 2 THEN 0 ELSE tries + 1 END, ef, el, et,
    CASE WHEN c = 'half_open' AND NOT ok THEN 'half_open_probe_failed' WHEN c = 'half_open' AND wins + 1 >= 2 THEN NULL ELSE reason END, true, blocked OR (c = 'half_open' AND (fresh OR wins < 1)),
    CASE WHEN blocked OR fresh THEN 10 WHEN c = 'half_open' THEN (10 + 90 * least(1.0::double, (wins + 1) / 2))::int END, CASE WHEN c <> 'closed' THEN 300 END, CASE WHEN c = 'closed' THEN NULL WHEN c = 'half_open' AND NOT fresh AND wins > 0 THEN 'best_effort' ELSE 'none' END, pause, c = 'half_open'
  FROM (SELECT *, c = 'open' AS blocked, CASE c WHEN 'open' THEN CASE before WHEN 'closed' THEN 600.0::double WHEN 'half_open' THEN 300.0::double ELSE 300.0::double - (tm - opened) END ELSE 0.0::double END AS pause FROM (
    SELECT id, key, rn, tm, ok, before, c, c = 'half_open' AND before = 'open' AS fresh, CASE WHEN c = 'open' AND before <> 'open' THEN tm ELSE opened END AS opened,
      CASE WHEN c <> before AND NOT (before = 'half_open' AND c = 'open') THEN 0 ELSE wins END AS wins, CASE WHEN c <> before AND NOT (before = 'half_open' AND c = 'open') THEN 0 ELSE tries END AS tries, ef, el, et, CASE WHEN before = 'closed' AND c = 'open' THEN trip ELSE reason END AS reason FROM (
      SELECT *, CASE before WHEN 'closed' THEN CASE WHEN trip IS NULL THEN 'closed' ELSE 'open' END WHEN 'open' THEN CASE WHEN 300.0::double - (tm - opened) <= 0 THEN 'half_open' ELSE 'open' END ELSE CASE WHEN tries >= 3 AND wins < 2 THEN 'open' ELSE 'half_open' END END AS c FROM (
        SELECT *, CASE WHEN NOT counts THEN NULL WHEN ef >= 0.3 THEN 'failure_rate' WHEN el >= 0.2 THEN 'rate_limit_rate' WHEN et >= 0.2 THEN 'timeout_rate' END AS trip FROM (
          SELECT s.id, s.key, s.rn, s.tm, s.ok, f.state AS before, f.opened, f.wins, f.tries, f.reason, f.state = 'closed' AND s.n >= 5 AS counts,
            CASE WHEN NOT (f.state = 'closed' AND s.n >= 5) THEN f.ef WHEN f.ef IS NULL THEN s.fr ELSE 0.5 * s.fr + 0.5 * f.ef END AS ef, CASE WHEN NOT (f.state = 'closed' AND s.n >= 5) THEN f.el WHEN f.el IS NULL THEN s.lr ELSE 0.5 * s.lr + 0.5 * f.el END AS el,
            CASE WHEN NOT (f.state = 'closed' AND s.n >= 5) THEN f.et WHEN f.et IS NULL THEN s.tr ELSE 0.5 * s.tr + 0.5 * f.et END AS et
          FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1))))))
SELECT id, key, state, reason, allow_sync, backfill_only, batch, win AS window, diff_mode, wait_seconds, probe, ef AS failed, el AS limited FROM f WHERE rn > 0"""


@query("breaker_states", _ROUNDS + _BREAKER)
def _states(db: Ledger):
    bad, k = F.col("event_type") == "error", F.col("k")
    rate = lambda test, value: F.when(test, value).otherwise(0.0)
    return breaker_states(_rounds(db).select("id", "key", "at", bad.cast("double").alias("failed_rate"), rate(k % 10 == 0, 0.5).alias("limited_rate"), rate(k % 13 == 0, 0.4).alias("timeout_rate"), (3 + k % 7).alias("n"), (~bad).alias("ok")))


@query("degradation", _ROUNDS + """
s AS (SELECT id, key, rn, (event_type = 'error' AND k % 4 < 2)::int AS h, (event_type = 'error' AND k % 4 = 2)::int AS t, (event_type = 'view' AND k % 3 = 0)::int AS e, 3 * (event_type = 'error' AND k % 4 = 3)::int AS l, (event_type = 'click' AND k % 5 = 0)::int AS u, event_type <> 'error' AND NOT (event_type = 'view' AND k % 3 = 0) AS ok FROM r),
f AS (SELECT NULL::bigint AS id, key, 0::bigint AS rn, 'best_effort' AS diff_mode, 100 AS batch, 3600 AS win, false AS paused, 0.0::double AS sleep, 0 AS h, 0 AS t, 0 AS e, 0 AS l, 0 AS streak FROM (SELECT DISTINCT key FROM s)
  UNION ALL
  SELECT id, key, rn, CASE WHEN mode = 'none' AND streak >= 5 THEN 'best_effort' ELSE mode END, CASE WHEN rh + rt > 0 THEN greatest(10, floor(batch * 0.5)::int) WHEN streak >= 5 AND batch < 100 THEN least(100, floor(batch * 1.2::double)::int) ELSE batch END,
    CASE WHEN rh > 0 THEN greatest(300, floor(win * 0.5)::int) WHEN streak >= 5 AND win < 3600 THEN least(3600, floor(win * 1.5)::int) ELSE win END, stop, greatest(CASE WHEN h > 0 THEN least(power(2.0::double, h - 1), 300.0) ELSE 0.0::double END, CASE WHEN stop THEN least(power(2.0::double, t), 300.0) ELSE 0.0::double END), h, t, e, l, streak
  FROM (SELECT *, t >= 3 OR e >= 3 AS stop, CASE WHEN h >= 3 OR l >= 5 THEN 'none' ELSE diff_mode END AS mode FROM (
    SELECT s.id, s.key, s.rn, f.diff_mode, f.batch, f.win, s.h AS rh, s.t AS rt, CASE WHEN s.h > 0 THEN f.h + s.h WHEN s.ok THEN 0 ELSE f.h END AS h, CASE WHEN s.t > 0 THEN f.t + s.t WHEN s.ok THEN 0 ELSE f.t END AS t, CASE WHEN s.e > 0 THEN f.e + s.e WHEN s.ok THEN 0 ELSE f.e END AS e, CASE WHEN s.l > 0 THEN f.l + s.l WHEN s.ok THEN 0 ELSE f.l END AS l,
      CASE WHEN s.ok AND s.h + s.t + s.e + s.l + s.u = 0 THEN f.streak + 1 ELSE 0 END AS streak FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1)))
SELECT id, key, diff_mode, batch, win AS window, sleep, paused FROM f WHERE rn > 0""")
def _degraded(db: Ledger):
    kind, k = F.col("event_type"), F.col("k")
    bad, down = kind == "error", (kind == "view") & (k % 3 == 0)
    n = lambda test: test.cast("int")
    return degraded(_rounds(db).select("id", "key", "at", n(bad & (k % 4 < 2)).alias("hits"), n(bad & (k % 4 == 2)).alias("timeouts"), n(down).alias("server_errors"), (n(bad & (k % 4 == 3)) * 3).alias("too_large"), n((kind == "click") & (k % 5 == 0)).alias("unknown"), (~bad & ~down).alias("succeeded")))


@query("patch_skips", _ROUNDS + """
s AS (SELECT id, key, rn, CASE WHEN event_type IN ('error', 'view') THEN 'timeout' WHEN event_type = 'click' OR k % 2 = 0 THEN 'content_too_large' WHEN k % 3 = 0 THEN 'other' END AS category FROM r),
f AS (SELECT NULL::bigint AS id, key, 0::bigint AS rn, 0 AS t, 0 AS l, false AS skip, NULL::varchar AS reason FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT id, key, rn, t, l, CASE WHEN category IS NULL THEN false ELSE skip OR (category = 'timeout' AND t >= 3) OR (category = 'content_too_large' AND l >= 5) END,
    CASE WHEN category IS NULL THEN NULL WHEN category = 'timeout' AND t >= 3 THEN 'consecutive_timeout=' || t || '>=threshold=3' WHEN category = 'content_too_large' AND l >= 5 THEN 'consecutive_content_too_large=' || l || '>=threshold=5' ELSE reason END
  FROM (SELECT s.id, s.key, s.rn, s.category, f.skip, f.reason, CASE s.category WHEN 'timeout' THEN f.t + 1 WHEN 'other' THEN f.t ELSE 0 END AS t, CASE s.category WHEN 'content_too_large' THEN f.l + 1 WHEN 'other' THEN f.l ELSE 0 END AS l FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1))
SELECT id, key, skip, reason FROM f WHERE rn > 0""")
def _skips(db: Ledger):
    kind, k = F.col("event_type"), F.col("k")
    category = F.when(kind.isin("error", "view"), "timeout").when((kind == "click") | (k % 2 == 0), "content_too_large").when(k % 3 == 0, "other")
    return patch_skips(_rounds(db).select("id", "key", "at", category.alias("category")))
