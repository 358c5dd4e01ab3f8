"""Cursors, counts, job payloads and audit events as JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger's contract.
COUNTERS = ("synced_count", "diff_count", "bulk_count", "degraded_count", "skipped_count", "total_429_hits", "timeout_count", "total_requests")
MODES, WINDOWS, DIFF_MODES = ("incremental", "backfill", "probe"), ("time", "rev"), ("always", "best_effort", "minimal", "none")


def upgraded_cursor(value: Column) -> Column:
    """A cursor of version 2 from one of version 1 or 2: the fields of the watermark and the statistics in their own objects."""
    get = lambda new, old: F.coalesce(F.get_json_object(value, f"$.{new}"), F.get_json_object(value, f"$.{old}"))
    mark = F.struct(get("watermark.last_rev", "last_rev").alias("last_rev"), get("watermark.last_commit_ts", "last_commit_ts").alias("last_commit_ts"), get("watermark.last_commit_sha", "last_commit_sha").alias("last_commit_sha"), get("watermark.last_mr_updated_at", "last_mr_updated_at").alias("last_mr_updated_at"), get("watermark.last_mr_iid", "last_mr_iid").alias("last_mr_iid"))
    stats = F.struct(get("stats.last_sync_at", "last_sync_at").alias("last_sync_at"), get("stats.last_sync_count", "last_sync_count").alias("last_sync_count"))
    return F.to_json(F.struct(F.lit(2).alias("version"), mark.alias("watermark"), stats.alias("stats")))


def counts(raw: Column) -> Column:
    """A struct of all counters of a JSON text, 0 where one is missing or no number."""
    return F.struct(*[F.coalesce(F.get_json_object(raw, f"$.{c}").try_cast("long"), F.lit(0)).alias(c) for c in COUNTERS])


def count_errors(raw: Column) -> Column:
    """Counters that are there but no number, or negative."""
    bad = [F.when(F.get_json_object(raw, f"$.{c}").isNotNull() & ~F.coalesce(F.get_json_object(raw, f"$.{c}").try_cast("long") >= 0, F.lit(False)), F.lit(c)) for c in COUNTERS]
    return F.array_compact(F.array(*bad))


def run_status(explicit: Column, error: Column, synced: Column, success: Column, default: str = "completed") -> Column:
    """What a run ended as, by the first rule that says something."""
    return F.when(explicit.isin("completed", "failed", "no_data"), explicit).when(explicit == "running", "failed").when(F.coalesce(error, F.lit("")) != "", "failed").when(synced == 0, "no_data").when(success, "completed").otherwise(default)


def payload_errors(raw: Column) -> Column:
    """Faults of a job payload: values outside their lists, a window without its ends or in the wrong order, sizes below 1."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    one_of = lambda k, xs: F.when(get(k).isNotNull() & ~get(k).isin(*xs), F.lit(f"{k} unknown"))
    low = lambda k: F.when(get(k).isNotNull() & ~F.coalesce(get(k).try_cast("long") >= 1, F.lit(False)), F.lit(f"{k} below 1"))
    back = get("mode") == "backfill"
    rev, time = get("window_type") == "rev", get("window_type") == "time"
    return F.array_compact(
        F.array(
            one_of("mode", MODES), one_of("window_type", WINDOWS), one_of("diff_mode", DIFF_MODES), low("batch_size"), low("total_chunks"),
            F.when(back & rev & (get("start_rev").isNull() | get("end_rev").isNull()), F.lit("rev window open")),
            F.when(back & time & (get("since").isNull() | get("until").isNull()), F.lit("time window open")),
            F.when(rev & (get("start_rev").try_cast("long") > get("end_rev").try_cast("long")), F.lit("rev window reversed")),
            F.when(time & (get("since") > get("until")), F.lit("time window reversed")),
        )
    )


def audit_event(source: Column, operation: Column, actor: Column, space: Column, action: Column, reason: Column, payload: Column, uris: Column, at: Column) -> Column:
    """An audit event as JSON; sections that are null are left out."""
    n = F.coalesce(F.size(uris), F.lit(0))
    return F.to_json(
        F.struct(
            F.lit("2.0").alias("schema_version"), source.alias("source"), operation.alias("operation"), actor.alias("actor_user_id"), space.alias("requested_space"),
            F.struct(action.alias("action"), reason.alias("reason")).alias("decision"), F.sha2(payload, 256).alias("payload_sha"), F.length(payload).alias("payload_len"),
            F.struct(F.greatest(n, F.lit(0)).alias("count"), F.slice(uris, 1, 5).alias("uris")).alias("evidence_summary"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_ts"),
        )
    )


def normalized_evidence(old: Column, new: Column) -> Column:
    """Evidence of version 2: the new one, or the old list of texts as external references."""
    external = F.transform(old, lambda u: F.struct(u.alias("uri"), F.lit(None).cast("string").alias("sha256"), F.lit("external").alias("kind")))
    return F.when(F.size(new) > 0, new).otherwise(F.coalesce(external, F.array().cast("array<struct<uri:string,sha256:string,kind:string>>")))


#: An item of evidence as a struct. origin is LEGACY where a bare text has become an item.
ITEM = "struct<uri: string, sha256: string, origin: string>"
#: Fixed values of the contract: the mark of items that were bare texts, and the codes of faults with what is named behind them.
LEGACY = "evidence_refs_legacy"
FAULT = "struct<place: int, code: string, error: boolean, said: string>"


def items_of(old: Column, new: Column) -> Column:
    """(items, source) of evidence: the new one (an array of ITEM), else the old list of texts without its empty ones, each as an item without a hash; source is v2, v1_mapped or none."""
    mapped = F.transform(F.filter(old, lambda u: u.isNotNull() & (u != "")), lambda u: F.struct(u.alias("uri"), F.lit("").alias("sha256"), F.lit(LEGACY).alias("origin")))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    none = F.array().cast(f"array<{ITEM}>")
    return F.struct(F.when(has(new), new).when(has(old), mapped).otherwise(none).alias("items"), F.when(has(new), "v2").when(has(old), "v1_mapped").otherwise("none").alias("source"))


def evidence_faults(items: Column) -> Column:
    """What is wrong with each item, an array of (place, code, error, said): the first rule that holds; an item without a fault has no row. Legacy items without a hash are warned of only."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))

    def rules(item: Column, place: Column) -> Column:
        at = F.concat(F.lit("evidence["), place.cast("string"), F.lit("]"))
        table = (
            ("EVIDENCE_MISSING_URI", True, empty(item["uri"]), at),
            ("EVIDENCE_LEGACY_NO_SHA256", False, empty(item["sha256"]) & F.coalesce(item["origin"] == LEGACY, F.lit(False)), F.concat_ws(":", at, item["uri"])),
            ("EVIDENCE_MISSING_SHA256", True, empty(item["sha256"]), F.concat_ws(":", at, item["uri"])),
            ("EVIDENCE_INVALID_SHA256", True, ~item["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.concat(at, F.lit(":"), F.substring(item["sha256"], 1, 16), F.lit("..."))),
        )
        out = None
        for code, error, holds, named in table:
            fault = F.struct(place.cast("int").alias("place"), F.lit(code).alias("code"), F.lit(error).alias("error"), F.concat_ws(":", F.lit(code), named).alias("said"))
            out = F.when(holds, fault) if out is None else out.when(holds, fault)
        return out

    return F.filter(F.transform(F.coalesce(items, F.array().cast(f"array<{ITEM}>")), rules), lambda f: f.isNotNull())


def validated_evidence(items: Column) -> Column:
    """(is_valid, error_codes, compat_warnings) of items; none is valid."""
    faults = evidence_faults(items)
    of = lambda error: F.transform(F.filter(faults, lambda f: f["error"] == F.lit(error)), lambda f: f["said"])
    return F.struct((~F.exists(faults, lambda f: f["error"])).alias("is_valid"), of(True).alias("error_codes"), of(False).alias("compat_warnings"))


def evidence_gate(mode: Column, items: Column) -> Column:
    """(action, reason) of a write by its evidence: strict refuses what is not valid, with the first code as its reason; compat, and no mode, let all pass."""
    first = F.get(F.filter(evidence_faults(items), lambda f: f["error"]), F.lit(0))["code"]
    stop = (F.coalesce(mode, F.lit("compat")) == "strict") & first.isNotNull()
    return F.struct(F.when(stop, "reject").otherwise("allow").alias("action"), F.when(stop, F.concat(F.lit("evidence_validation:"), F.lower(first))).otherwise("evidence_accepted").alias("reason"))


def correlation(given: Column, row: Column) -> Column:
    """A correlation id of the contract's form; for one of another form, one that a hash of it and of the row gives, so reruns agree."""
    made = F.concat(F.lit("corr-"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(given, F.lit("")), row.cast("string")), 256), 1, 16))
    return F.when(given.rlike("^corr-[0-9a-f]{16}$"), given).otherwise(made)


def _json(fields: dict[str, Column], nulls: bool) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": str(not nulls).lower()})


def event_json(source: str, operation: Column, at: Column, correlation_id: Column, items: Column, given: dict[str, Column], extra: dict[str, Column] | None = None) -> Column:
    """An audit event as JSON. given names its columns: actor, spaces, action, reason, payload and trim are told even where they are null; ids of the
    outbox, retries and the policy's mode are not. Of the groups policy, validation and pointer an event has those that say something. extra holds what only one source tells; where all of it is null it is left out.
    """
    none = F.lit(None).cast("string")
    has = lambda name: given.get(name, none)
    group = lambda names, when: F.when(when, F.struct(*[has(n).alias(short) for n, short in names.items()]))
    uris = F.transform(F.filter(items, lambda i: F.coalesce(i["uri"], F.lit("")) != ""), lambda i: i["uri"])
    n = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))
    strong = F.coalesce(F.exists(items, lambda i: F.coalesce(i["sha256"], F.lit("")) != ""), F.lit(False))
    core = {
        "schema_version": F.lit("2.0"), "source": F.lit(source), "operation": operation, "correlation_id": correlation_id, "actor_user_id": has("actor_user_id"), "requested_space": has("requested_space"), "final_space": has("final_space"),
        "decision": F.struct(has("action").alias("action"), has("reason").alias("reason")), "payload_sha": has("payload_sha"), "payload_len": given.get("payload_len", F.lit(None).cast("int")),
        "evidence_summary": F.struct(n.alias("count"), strong.alias("has_strong"), F.slice(F.coalesce(uris, F.array().cast("array<string>")), 1, 5).alias("uris")),
        "trim": F.struct(F.coalesce(given.get("was_trimmed", F.lit(False)), F.lit(False)).alias("was_trimmed"), has("trim_why").alias("why"), given.get("original_len", F.lit(None).cast("int")).alias("original_len")),
        "refs": F.coalesce(uris, F.array().cast("array<string>")), "event_ts": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    said = lambda *names: F.concat(*[F.coalesce(has(n).cast("string"), F.lit("")) for n in names])
    policy = {"policy_mode": "mode", "policy_mode_reason": "mode_reason", "policy_version": "policy_version", "policy_source": "policy_source"}
    pointed = F.coalesce(given.get("is_pointerized", F.lit(False)), F.lit(False))
    rest = {name: given[name] for name in ("outbox_id", "memory_id", "retry_count", "next_attempt_at", "policy_mode") if name in given}
    rest["policy"] = F.when((said(*policy) != "") | pointed, F.struct(*[has(c).alias(short) for c, short in policy.items()], pointed.alias("is_pointerized")))
    rest["validation"] = group({"validate_refs_effective": "validate_refs_effective", "validate_refs_reason": "validate_refs_reason"}, said("validate_refs_effective", "validate_refs_reason") != "")
    rest["pointer"] = F.when(pointed & (said("requested_space") != "") & (said("pointer_space") != ""), F.struct(has("requested_space").alias("from_space"), has("pointer_space").alias("to_space"), has("pointer_reason").alias("reason"), F.lit(True).alias("preserved")))
    if extra:
        told = F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in extra.values()]) != ""
        rest["extra"] = F.when(told, F.struct(*[c.alias(name) for name, c in extra.items()]))
    one, two = _json(core, True), _json(rest, False)
    return F.when(two == "{}", one).otherwise(F.concat(F.substr(one, F.lit(1), F.length(one) - 1), F.lit(","), F.substr(two, F.lit(2), F.length(two))))


def gateway_event(operation: Column, at: Column, correlation_id: Column, items: Column, given: dict[str, Column], intended: Column | None = None) -> Column:
    """An event of a gateway; intended is what a redirected write was meant to be."""
    return event_json("gateway", operation, at, correlation_id, items, given, {} if intended is None else {"intended_action": intended})


def worker_event(operation: Column, at: Column, correlation_id: Column, given: dict[str, Column], worker: Column, attempt: Column) -> Column:
    """An event of an outbox worker: requested and final space are one, and who worked is told beside the correlation id."""
    both = given | {"requested_space": given["target_space"], "final_space": given["target_space"]}
    return event_json("outbox_worker", operation, at, correlation_id, F.array().cast(f"array<{ITEM}>"), both, {"correlation_id": correlation_id, "worker_id": F.nullif(worker, F.lit("")), "attempt_id": F.nullif(attempt, F.lit(""))})


def reconcile_event(operation: Column, at: Column, correlation_id: Column, given: dict[str, Column], locked_by: Column, locked_at: Column) -> Column:
    """An event of a reconciliation, with the lock that it found."""
    both = given | {"requested_space": given["target_space"], "final_space": given["target_space"]}
    return event_json("reconcile_outbox", operation, at, correlation_id, F.array().cast(f"array<{ITEM}>"), both, {"reconciled": F.lit(True), "original_locked_by": F.nullif(locked_by, F.lit("")), "original_locked_at": F.date_format(locked_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")})
