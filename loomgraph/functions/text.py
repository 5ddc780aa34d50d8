"""Column functions on names, paths, symbol ids, log messages and platform vocabularies. All are JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path prefixes of containers, of which the first that fits is removed.
CONTAINER_PREFIXES = (r"^/var/task/", r"^/app/", r"^/home/\w+/", r"^/opt/\w+/", r"^/workspace/")
#: Words in a rule's name and the kind of sink that they tell, the first that fits counting.
SINK_KINDS = (
    ("sql-injection", "sql"), ("xss", "xss"), ("path-injection", "path"), ("path-traversal", "path"), ("code-injection", "code"),
    ("command-injection", "command"), ("prototype-pollution", "prototype"), ("rate-limiting", "rate-limit"),
)
#: Known errors, their category, and the pattern that tells them.
ERROR_PATTERNS = (
    ("supabase-jwt-as-github-token", "auth", r"https://eyJ[\w.]+@github\.com"),
    ("git-auth-failure", "auth", r"(?i)fatal: (?:could not read (?:Username|Password)|Authentication failed|repository .+ not found)"),
    ("cors-error", "network", r"has been blocked by CORS policy|Access-Control-Allow-Origin"),
    ("econnrefused", "network", r"ECONNREFUSED|connect ECONNREFUSED"),
    ("neo4j-connection", "database", r"(?i)Neo4j|ServiceUnavailable.*bolt|failed to connect.*7687"),
    ("supabase-rls", "database", r"new row violates row-level security|permission denied for table"),
    ("module-not-found", "build", r"Cannot find module|Module not found|ERR_MODULE_NOT_FOUND"),
    ("sigterm", "runtime", r"signal SIGTERM|Lifecycle script .+ failed.*SIGTERM"),
    ("scip-parse-invalid-arg", "build", r"Parse skipped .+ \(\w+\): Invalid argument"),
    ("rate-limit", "network", r"(?i)rate limit|429|too many requests"),
)
#: Level and deployment status words of two platforms, in lower case; the third value is what any other word becomes.
LEVELS = {
    "p1": ({"error": "error", "stderr": "error", "fatal": "error", "warning": "warn"}, "info"),
    "p2": ({"error": "error", "err": "error", "warn": "warn", "warning": "warn"}, "info"),
}
STATUSES = {
    "p1": {"ready": "ready", "error": "error", "building": "building", "initializing": "building", "canceled": "cancelled", "queued": "running"},
    "p2": {"success": "ready", "failed": "error", "building": "building", "deploying": "building", "initializing": "building", "crashed": "error", "removed": "cancelled", "cancelled": "cancelled"},
}
RANKS = {"info": 0, "warn": 1, "error": 2}
SEVERITY_ORDER = {"error": 0, "warning": 1}


def lookup(key: Column, table: dict[str, str | int], default) -> Column:
    """table[key], or the default; a literal map in the plan."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(pairs[F.coalesce(key, F.lit(""))], F.lit(default) if not isinstance(default, Column) else default)


def repo_name(url: Column) -> Column:
    """The last segment of a repository's address, without .git."""
    return F.regexp_extract(url, r"/([^/]+?)(?:\.git)?/?$", 1)


def package_name(specifier: Column) -> Column:
    """The scope and name of a scoped import, or the first segment."""
    parts = F.split(specifier, "/")
    return F.when(F.startswith(specifier, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def strip_prefix(path: Column) -> Column:
    fits = reduce(lambda rest, p: F.when(path.rlike(p), F.regexp_replace(path, p, "")).otherwise(rest), reversed(CONTAINER_PREFIXES), path)
    return fits


def sink_kind(query_id: Column) -> Column:
    name = F.element_at(F.split(query_id, "/"), -1)
    return reduce(lambda rest, x: F.when(name.contains(x[0]), x[1]).otherwise(rest), reversed(SINK_KINDS), name)


def error_patterns(text: Column) -> Column:
    """The names of all known errors that the text shows, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, _, p in ERROR_PATTERNS]))


def error_category(name: Column) -> Column:
    return lookup(name, {n: c for n, c, _ in ERROR_PATTERNS}, None)


def log_prefix(message: Column) -> tuple[Column, Column, Column]:
    """module and action of a message such as `[module] action failed`, and the error type; null where absent."""
    p = r"(?i)^\[(\w[\w-]*)\]\s+(.+?)(?:\s+failed|\s+error|\s+crashed)"
    none = lambda c: F.nullif(c, F.lit(""))
    return none(F.regexp_extract(message, p, 1)), none(F.regexp_extract(message, p, 2)), none(F.regexp_extract(message, r":\s+(\w+Error):", 1))


def log_level(platform: str, word: Column) -> Column:
    table, other = LEVELS[platform]
    return lookup(F.lower(word), table, other)


def deploy_status(platform: str, word: Column) -> Column:
    low = F.lower(F.coalesce(word, F.lit("")))
    return lookup(low, STATUSES[platform], F.coalesce(F.nullif(low, F.lit("")), F.lit("unknown")))


def at_least(level: Column, threshold: str) -> Column:
    """Unknown levels rank lowest; an unknown threshold is warn."""
    return lookup(level, RANKS, 0) >= RANKS.get(threshold, 1)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_ORDER, 2)


def symbol_id(text: Column) -> tuple[Column, Column, Column]:
    """file_path, name and container of an index's symbol id `scheme manager package version path`file`/Container#name().`; null if it is none.

    The path begins after the fourth space, or after the last where there are fewer.
    """
    quoted = r"`([^`]+)`"
    head = F.regexp_extract(text, r"^([^`]*)`", 1)
    after = F.regexp_extract(text, r"^[^`]*`[^`]+`.(.*)$", 1)
    prefix = F.when(head.rlike(r"^(?:[^ ]* ){4}"), F.regexp_replace(head, r"^(?:[^ ]* ){4}", "")).otherwise(F.regexp_replace(head, r"^.* ", ""))
    parts = F.filter(F.transform(F.regexp_extract_all(after, F.lit(r"[^.#]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"[()]", "")), lambda x: x != "")
    ok = text.rlike(quoted) & (F.size(parts) > 0)
    return (
        F.when(ok, F.concat(prefix, F.regexp_extract(text, quoted, 1))), F.when(ok, F.get(parts, F.size(parts) - 1)), F.when(ok & (F.size(parts) > 1), F.get(parts, F.lit(0))),
    )


def or_null(value: Column) -> Column:
    """null where the value is zero or empty, as defaulting by truth does."""
    return F.when((value.cast("string") != "") & (value.cast("string") != "0"), value)
