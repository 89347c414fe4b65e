"""Decision tables over one row, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each provider's states and the ones they stand for.
HETZNER_STATES = {"running": "running", "off": "off", "initializing": "transitioning", "starting": "transitioning", "stopping": "transitioning", "rebuilding": "transitioning", "migrating": "transitioning", "deleting": "transitioning"}
DO_STATES = {"active": "running", "off": "off", "new": "transitioning", "archive": "transitioning"}
#: The kinds of errors, their stable codes, and the exit codes of a run that ends with one.
EXIT_CODES = {"Usage": 2, "ConfigInvalid": 2, "Conflict": 3, "LimitExceeded": 4, "Auth": 5, "ProviderRejected": 5, "Transport": 5, "OutcomeUnknown": 5, "IncompleteInventory": 5, "NotFound": 6, "Aborted": 7, "WaitTimeout": 9, "Internal": 1}
ERROR_CODES = {"Usage": "usage", "ConfigInvalid": "config-invalid", "Conflict": "conflict", "LimitExceeded": "limit-exceeded", "Auth": "auth", "ProviderRejected": "provider-rejected", "Transport": "transport", "OutcomeUnknown": "outcome-unknown", "IncompleteInventory": "incomplete-inventory", "NotFound": "not-found", "Aborted": "aborted", "WaitTimeout": "wait-timeout", "Internal": "internal"}
LEVELS = ("Trace", "Debug", "Info", "Warn", "Error", "None")


def mapped(c: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def power_status(raw: Column, provider: Column) -> Column:
    return F.when(provider == "hetzner", mapped(raw, HETZNER_STATES, "unknown")).when(provider == "digitalocean", mapped(raw, DO_STATES, "unknown")).otherwise("unknown")


def decide(action: Column, status: Column) -> Column:
    return (
        F.when(~F.coalesce(status.isin("running", "off"), F.lit(False)), "Conflict")
        .when(action == "delete", "Mutate")
        .when(action == "stop", F.when(status == "running", "Mutate").otherwise("Noop"))
        .when(action == "start", F.when(status == "off", "Mutate").otherwise("Noop"))
    )


def confirmation_required(action: Column, yes: Column, dry_run: Column) -> Column:
    return action.isin("stop", "delete") & ~yes & ~dry_run


def unchanged(before: Column, after: Column) -> Column:
    return (before["status"] == after["status"]) & before["raw_status"].eqNullSafe(after["raw_status"])


def exit_code(error: Column) -> Column:
    return F.when(error.isNull(), 0).otherwise(mapped(error, EXIT_CODES, 1))


def response_class(status: Column) -> Column:
    """The kind of error that a status stands for; null for what succeeded."""
    return F.when(status.between(200, 299), None).when(status.isin(401, 403), "Auth").when(status == 404, "NotFound").when((status == 429) | status.between(500, 599), "Transport").when(status.isNotNull(), "ProviderRejected")


def retry_delay(is_read: Column, attempt: Column, retryable: Column, elapsed_s: Column, retry_after_s: Column) -> Column:
    """Seconds to wait, or null for no retry; attempts count from 0, and 90 s are all there is."""
    delay = F.coalesce(retry_after_s.cast("double"), F.when(attempt == 0, 1.0).otherwise(3.0))
    return F.when(is_read & (attempt < 2) & retryable & (elapsed_s + delay <= 90), delay)


def evaluate(kind: Column, target: Column, action_state: Column, status: Column, missing: Column) -> Column:
    """How an observation stands to what is waited for: a status, a machine that is gone (absent), or a new one that has
    become stable (created). A failed action fails whatever else is seen, and so does a machine that is missing, but
    where that is waited for."""
    reached = F.when(kind == "status", status == target).otherwise(status.isin("running", "off"))
    return (
        F.when(F.coalesce(action_state == "error", F.lit(False)), "failed")
        .when(kind == "absent", F.when(missing, "settled").otherwise("pending"))
        .when(missing, F.when(kind == "created", "pending").otherwise("failed"))
        .when(F.coalesce(reached, F.lit(False)), "settled")
        .otherwise("pending")
    )


def settled(status: Column, raw: Column) -> Column:
    """Where a transition ends; settled states stay."""
    return F.when(status != "transitioning", status).when(raw.isin("stopping", "archive"), "off").when(raw == "deleting", "unknown").otherwise("running")


def log_level(env: Column, verbose: Column) -> Column:
    """The level that is named, if there is one of that name; otherwise Debug for verbose runs and Warn for others."""
    named = F.initcap(F.lower(env))
    return F.when(named.isin(*LEVELS), named).when(verbose, "Debug").otherwise("Warn")


def providers(flag: Column, default: Column, is_list: Column | None = None) -> Column:
    """The providers to read, or null for a usage error: where none is named, or all for another command than list."""
    chosen = F.coalesce(flag, default)
    both = F.when(F.lit(True) if is_list is None else is_list, F.array(F.lit("digitalocean"), F.lit("hetzner")))
    return F.when(chosen == "all", both).when(chosen.isin("hetzner", "digitalocean"), F.array(chosen))
