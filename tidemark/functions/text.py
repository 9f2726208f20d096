"""Texts for people: sizes, durations, status words, redaction, classes of errors.  All are Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, words and patterns of the formats.
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
TRANSIENT = (
    "timeout", "timed out", "deadlock", "lock wait", "too many connections", "server has gone away", "lost connection", "connection reset",
    "connection refused", "can't connect", "cannot connect", "temporary failure", "try again", "resource temporarily unavailable",
)
CORRUPT = (
    "table is marked as crashed", "marked as crashed", "incorrect key file", "table is corrupted", "table corrupt", "corrupt table", "checksum mismatch",
    "error: 1034", "error 1034", "error: 126", "error 126", "error: 127", "error 127", "error: 134", "error 134", "error: 135", "error 135", "error: 145", "error 145",
)
SENSITIVE = (
    "access-key", "access_key", "authorization", "aws_", "child environment", "credential", "endpoint", "mysql_pwd", "password", "pgpassword",
    "provider response", "request id", "response body", "secret", "token",
)
HEADLINES = {
    "success": "Backup succeeded", "failed": "Backup failed", "partial": "Backup incomplete", "cancelled": "Backup cancelled", "skipped": "Backup skipped", "no_change": "No changes detected",
}
URL, SECRET, PATH = r"https?://[^\s]+", r"(?i)(password|secret|access[_-]?key|webhook[_-]?url)=([^\s,;]+)", r"""(^|[\s("'=])(/[^\s,;:)"']+)"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_bytes(size: Column | str) -> Column:
    """1024 units with one decimal; below 1024 `N B`.  Ties go to the even digit, as for exact binary values."""
    size = col(size)
    out = F.concat(size.cast("string"), F.lit(" B"))
    value = lambda k: F.format_string("%.1f", F.bround(size / F.lit(float(1024**k)), 1))
    cases = F
    for k in range(len(UNITS), 0, -1):
        cases = cases.when(size >= 1024**k, F.concat(value(k), F.lit(f" {UNITS[k - 1]}")))
    return cases.otherwise(out)


def human_duration(seconds: Column | str) -> Column:
    """`42 s`, `3 min`, `2 h`, `2 h 5 min`."""
    s = col(seconds)
    whole = lambda n: F.floor(s / n)
    minutes = F.floor(F.pmod(s, F.lit(3600)) / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(whole(60).cast("string"), F.lit(" min")))
        .when(minutes == 0, F.concat(whole(3600).cast("string"), F.lit(" h"))).otherwise(F.concat(whole(3600).cast("string"), F.lit(" h "), minutes.cast("string"), F.lit(" min")))
    )


def compact_duration(millis: Column | str) -> Column:
    """`1h2m3s`, `1m30s`, `2s`, in whole seconds."""
    s = F.floor(col(millis) / 1000)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat(text(h, "h"), text(m, "m"), text(r, "s"))).when(m > 0, F.concat(text(m, "m"), text(r, "s"))).otherwise(text(r, "s"))


def exact_duration(millis: Column | str) -> Column:
    """`1h2m3.5s`, `1m30s`, `2.25s`, `345ms`, `0s`: nothing is rounded."""
    ms = col(millis)
    whole = lambda n: F.floor(n).cast("string")
    rest = F.pmod(ms, F.lit(60_000))
    digits = F.rtrim(F.lpad(F.pmod(rest, F.lit(1000)).cast("string"), 3, "0"), F.lit("0"))
    seconds = F.concat(whole(rest / 1000), F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)), F.lit("s"))
    hours = F.when(ms >= 3_600_000, F.concat(whole(ms / 3_600_000), F.lit("h"))).otherwise("")
    minutes = F.when(ms >= 60_000, F.concat(whole(F.pmod(ms, F.lit(3_600_000)) / 60_000), F.lit("m"))).otherwise("")
    return F.when(ms == 0, "0s").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(hours, minutes, seconds))


def plural(n: Column | str, one: str, many: str | None = None) -> Column:
    n = col(n)
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many or one + 's'}")))


def items_size(count: Column | str, size: Column | str) -> Column:
    """`3 items (2.1 GiB)`; empty for none."""
    return F.when(col(count) <= 0, "").otherwise(F.concat(plural(count, "item"), F.lit(" ("), human_bytes(size), F.lit(")")))


def redact(text: Column | str) -> Column:
    """URLs, values of sensitive names and absolute paths give way to marks."""
    out = F.regexp_replace(col(text), URL, "<redacted-url>")
    return F.regexp_replace(F.regexp_replace(out, SECRET, "$1=<redacted>"), PATH, "$1<redacted-path>")


def safe_field(text: Column | str) -> Column:
    """One line for a table: white space collapsed, empty becomes a dash; hidden as a whole if any part could give something away.

    All that is hidden is one pattern, since each further mention of the text would make it anew.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    hidden = "|".join((*map(re.escape, ("://", ":\\", "../", "..\\", *SENSITIVE)), "(^| )/"))
    return F.when(flat == "", "-").when(F.lower(flat).rlike(hidden), "[redacted]").otherwise(flat)


def cause_chain(messages: Column | str) -> Column:
    """Messages from the outermost to the cause, each once, joined by a colon."""
    return F.array_join(F.array_distinct(F.filter(F.transform(col(messages), lambda m: F.trim(m)), lambda m: m != "")), ": ")


def first_line(text: Column | str, most: int = 200) -> Column:
    """The first line that isn't empty, cut to whole characters of at most `most` bytes.

    A cut character shows as the replacement character at the end, which is dropped.
    """
    line = F.get(F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    cut = F.regexp_replace(F.substring(F.encode(line, "UTF-8"), 1, most).cast("string"), "�+$", "")
    # how much of the last character is left: byte counts decide, so that nothing valid is dropped
    return F.coalesce(F.when(F.octet_length(line) <= most, line).otherwise(cut), F.lit(""))


def error_class(message: Column | str) -> Column:
    """transient, corruption or other; transient wins."""
    low = F.lower(F.coalesce(col(message), F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(any_of(TRANSIENT), "transient").when(any_of(CORRUPT), "corruption").otherwise("other")


def headline(status: Column | str, site: Column | str, recovery: Column | None = None) -> Column:
    """The first sentence of a notification."""
    words = F
    for k, v in HEADLINES.items():
        words = words.when(col(status) == k, v)
    plain = F.concat(words.otherwise(col(status)), F.lit(" for "), col(site))
    return plain if recovery is None else F.when(recovery, F.concat(F.lit("Backup recovered for "), col(site))).otherwise(plain)


#: What a notification says of a run that recovered, by its status, and by the category of its error.
RECOVERED = "A complete backup is available again. The previous backup incident has recovered."
SUCCEEDED = "The backup completed successfully."
PARTIAL = "The snapshot was saved, but {0} source entries could not be read. Run the backup again to complete it."
TOO_SOON = "No backup was created because minimum_interval has not elapsed since the last successful backup."
IDENTICAL = "The new backup is identical to the last one."
IDLE = " Likely an idle app, or the database dump silently failed."
STOPPED = "The backup was stopped before it finished."
FAILURES = {
    "config": "A setting needs attention. The backup configuration was rejected, so the backup did not run.",
    "preflight": "The backup did not start. A check before the backup failed.",
    "execution": "The backup ended with an execution error.",
    "storage": "The backup ran but could not be saved to its destination.",
    "persistence": "The backup finished but its result could not be recorded in the history database.",
}
UNEXPECTED = "An unexpected problem stopped the backup."


def description(status: Column, category: Column, items: Column, size: Column, skipped: Column, recovery: Column, databases: Column) -> Column:
    """The paragraph of a notification: what became of a run, and what it prepared; anchors of unchanged runs aren't told."""
    prepared = F.when(items > 0, F.concat(F.lit(" "), items_size(items, size), F.when(items == 1, " was prepared.").otherwise(" were prepared."))).otherwise("")
    failure = F.when(status == "cancelled", STOPPED)
    for name, words in FAILURES.items():
        failure = failure.when(category == name, words)
    head, tail = PARTIAL.split("{0}")
    return (
        F.when(recovery, RECOVERED).when(status == "success", F.concat(F.lit(SUCCEEDED), prepared)).when(status == "partial", F.concat(F.lit(head), skipped.cast("string"), F.lit(tail)))
        .when((status == "skipped") & (category == "minimum_interval"), TOO_SOON).when(status == "no_change", F.concat(F.lit(IDENTICAL), F.when(databases, IDLE).otherwise("")))
        .otherwise(F.concat(failure.otherwise(UNEXPECTED), prepared))
    )


#: What a report says when nothing ran, when runs failed, when some were incomplete, and when all is well.
REPORT_TEXTS = (
    "We have not detected any backup runs for this period.\n\n**Recommended steps:**\n1. Verify that your application schedule or cron job is actively running.\n2. Ensure the {product} history database is accessible.",
    "Backup activity was recorded, but we detected **{failed} failed run(s)** during this period.\n\n**Recommended steps:**\n1. Check your storage configuration destination (`{storage}`).\n2. Inspect the failed backup logs and attempt to force a backup by running `{command} backup run {site} --force` to ensure the backup process is functioning correctly.",
    "Backup activity was recorded, but we detected **{partial} incomplete run(s)** during this period. Some source entries were not included.\n\n**Recommended steps:**\n1. Check the source data and local backup logs.\n2. Run `{command} backup run {site} --force` to complete the snapshot.",
    "All scheduled backup activities were recorded successfully for this period. No further action is required.",
)


def report_description(total: Column, failed: Column, partial: Column, storage: Column | str, site: Column | str, product: str = "Backup", command: str = "backup") -> Column:
    """What a report says: nothing ran, something failed, something was incomplete, all is well; storage and site are the first ones.

    product and command name the program whose history it is and the command that runs it.
    """
    known = {"failed": failed.cast("string"), "partial": partial.cast("string"), "storage": col(storage), "site": col(site), "product": F.lit(product), "command": F.lit(command)}
    filled = lambda words: F.concat(*(known[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{[a-z]+\})", words) if x))
    none, bad, some, well = map(filled, REPORT_TEXTS)
    return F.when(total == 0, none).when(failed > 0, bad).when(partial > 0, some).otherwise(well)


def quote_identifier(name: Column | str) -> Column:
    return F.concat(F.lit("`"), F.replace(col(name), F.lit("`"), F.lit("``")), F.lit("`"))


def fence(text: Column | str, most: int = 1024) -> Column:
    """A code block for chats: fences inside are broken, the whole is cut to `most` characters with an ellipsis."""
    safe = F.replace(col(text), F.lit("```"), F.lit("'''"))
    room = most - 8
    return F.concat(F.lit("```\n"), F.when(F.length(safe) > room, F.concat(F.substring(safe, 1, room - 1), F.lit("…"))).otherwise(safe), F.lit("\n```"))


def incident_key(server: Column, site: Column, scope: Column, channel: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in (server, site, scope, channel))), 256)


def fingerprint(event: Column, category: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in (event, category, message))), 256)


def short_id(value: Column | str) -> Column:
    return F.substring(col(value), 1, 8)


def utc_text(at: Column | str) -> Column:
    return F.date_format(col(at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_id(value: Column | str) -> Column:
    return col(value).rlike("^[0-9a-fA-F]{64}$")
