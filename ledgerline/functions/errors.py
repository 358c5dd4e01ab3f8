"""Classes of errors and waits, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger's contract: categories, key words in their order of precedence, and base waits in seconds.
PERMANENT_CATEGORIES = ("auth_error", "auth_missing", "auth_invalid", "repo_not_found", "repo_type_unknown", "permission_denied")
PERMANENT_WORDS = ("401", "403", "404", "authentication failed", "unauthorized", "forbidden", "not found", "does not exist", "invalid token", "token expired")
TRANSIENT_CATEGORIES = ("rate_limit", "timeout", "network", "server_error", "connection", "lease_lost")
TRANSIENT_WORDS = ("429", "rate limit", "too many requests", "timeout", "timed out", "connection", "connect", "network", "502", "503", "504", "bad gateway", "service unavailable", "gateway timeout", "temporary", "retry")
BASE_WAIT = {"rate_limit": 120, "timeout": 30, "network": 60, "server_error": 90, "connection": 45, "lease_lost": 0, "lock_held": 0}
IGNORED_CATEGORIES = ("lock_held",)
DEFAULT_WAIT, LONGEST_WAIT = 60, 3600
RATE_LIMIT_WORDS = ("429", "rate limit", "too many requests")
TIMEOUT_WORDS = ("timeout", "timed out")
SERVER_WORDS = ("502", "503", "504")
NETWORK_WORDS = ("connection", "network")
AUTH_WORDS = ("401", "unauthorized", "authentication", "token")
DENIED_WORDS = ("403", "forbidden", "permission")
MISSING_WORDS = ("404", "not found", "does not exist")


def has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first(pairs, otherwise) -> Column:
    """The value of the first pair whose condition holds."""
    (condition, value), *rest = pairs
    return reduce(lambda out, p: out.when(p[0], F.lit(p[1])), rest, F.when(condition, F.lit(value))).otherwise(otherwise)


def transient_category(message: Column) -> Column:
    """The kind of a transient error by its text; null if the text has no sign of one."""
    return _first([(has_any(message, RATE_LIMIT_WORDS), "rate_limit"), (has_any(message, TIMEOUT_WORDS), "timeout"), (has_any(message, SERVER_WORDS), "server_error"), (has_any(message, NETWORK_WORDS), "network")], F.lit(None).cast("string"))


def is_transient(category: Column, message: Column) -> Column:
    return F.coalesce(F.lower(category).isin(*TRANSIENT_CATEGORIES), F.lit(False)) | F.coalesce(has_any(F.lower(message), TRANSIENT_WORDS), F.lit(False))


def is_permanent(category: Column) -> Column:
    return F.coalesce(F.lower(category).isin(*PERMANENT_CATEGORIES), F.lit(False))


def is_ignored(category: Column) -> Column:
    """Whether an outcome is no failure at all, such as a lock that another worker holds: it counts for no attempt and no rate."""
    return F.coalesce(F.lower(category).isin(*IGNORED_CATEGORIES), F.lit(False))


def classify_last_error(text: Column) -> Column:
    """(permanent, transient, category) of a job's last error; category '' where it says nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [(low.contains(c), c) for c in PERMANENT_CATEGORIES]
    worded = has_any(low, PERMANENT_WORDS)
    permanent = _first([*named, (worded & has_any(low, AUTH_WORDS), "auth_error"), (worded & has_any(low, DENIED_WORDS), "permission_denied"), (worded & has_any(low, MISSING_WORDS), "repo_not_found")], F.lit(None).cast("string"))
    passing = F.when(has_any(low, TRANSIENT_WORDS), F.coalesce(transient_category(low), _first([(low.contains(c), c) for c in TRANSIENT_CATEGORIES], F.lit("default"))))
    return F.struct(permanent.isNotNull().alias("permanent"), (permanent.isNull() & passing.isNotNull()).alias("transient"), F.coalesce(permanent, passing, F.lit("")).alias("category"))


def classify_exception(kind: Column, message: Column) -> Column:
    """The category of an exception by its type's name, then by its message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return _first(
        [
            (kind.contains("Timeout"), "timeout"), (kind.contains("Connection"), "connection"),
            (has_any(low, ("401", "unauthorized")), "auth_error"), (has_any(low, ("403", "forbidden")), "permission_denied"), (has_any(low, ("404", "not found")), "repo_not_found"),
            (has_any(low, RATE_LIMIT_WORDS), "rate_limit"), (has_any(low, SERVER_WORDS), "server_error"), (has_any(low, TIMEOUT_WORDS), "timeout"), (has_any(low, NETWORK_WORDS), "network"),
        ],
        F.lit("exception"),
    )


def base_wait(category: Column, message: Column | None = None) -> Column:
    """The wait of a category; of an unknown one that of its message's kind; else the default."""
    low = F.lower(F.coalesce(message, F.lit(""))) if message is not None else F.lit("")
    name = F.coalesce(F.when(F.lower(category).isin(*BASE_WAIT), F.lower(category)), transient_category(low))
    return _first([(name == c, w) for c, w in BASE_WAIT.items()], F.lit(DEFAULT_WAIT))


def backoff_seconds(category: Column, attempts: Column, message: Column | None = None, longest: int = LONGEST_WAIT) -> Column:
    """base * 2 ** (attempts - 1), at most `longest`."""
    return F.least(F.lit(longest), base_wait(category, message) * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def resolved_backoff(retry_after: Column, category: Column, message: Column, default: int = DEFAULT_WAIT) -> Column:
    """(seconds, source): what the server asked for, else the category's, else the default."""
    known = F.lower(category).isin(*BASE_WAIT)
    wait = base_wait(category, message)
    named = F.coalesce(known, F.lit(False)) | (F.coalesce(message != "", F.lit(False)) & (wait != DEFAULT_WAIT))
    asked = F.coalesce(retry_after > 0, F.lit(False))
    return F.struct(F.when(asked, retry_after).when(named, wait).otherwise(F.lit(default)).cast("long").alias("seconds"), F.when(asked, "retry_after").when(named, "error_category").otherwise("default").alias("source"))


def jittered(base: Column, key: Column, spread: float = 0.1) -> Column:
    """base times 1 +- spread, the same for the same key, so that reruns agree."""
    u = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(10_000)) / F.lit(10_000.0)
    return base * (1 + spread * (2 * u - 1))
