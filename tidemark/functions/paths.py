"""Paths and object keys: exclude patterns, containment, safety, prefixes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import col

SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


class BadPattern(ValueError):
    """A pattern that can't be used."""


def _glob(pattern: str) -> str:
    """A regular expression for one glob; no wildcard crosses a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise BadPattern(pattern)
            body = pattern[i + 1 : end]
            out += "[" + ("^/" + body[1:] if body[0] == "^" else body).replace("[", r"\[").replace("&&", r"&\&") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def exclude_regex(pattern: str, root: str) -> str:
    """What an exclude pattern means below a root, as one anchored regular expression over absolute paths.

    `/**` at the end takes a directory, named literally, and all below; an absolute path without wildcards
    does so too.  Other absolute patterns are globs of whole paths; other relative ones are globs of the
    last name, or of the path from the root.
    """
    root = root.rstrip("/")
    tree = pattern.endswith("/**")
    body = (pattern[:-3] if tree else pattern).rstrip("/")
    if not body or "**" in body:
        raise BadPattern(pattern)
    glob = _glob(body)
    below = f"{re.escape(body)}(?:/.*)?"
    if body.startswith("/"):
        return f"^{below if tree or not set('*?[') & set(body) else glob}$"
    if tree:
        return f"^{re.escape(root)}/{below}$"
    return f"^{re.escape(root)}/{glob}$" if "/" in body else f"^(?:.*/)?{glob}$"


def excluded(path: Column | str, patterns: list[str], root: str) -> Column:
    """Whether any pattern excludes the path; the patterns become one expression, so nothing is joined."""
    return col(path).rlike("|".join(f"(?:{exclude_regex(p, root)})" for p in patterns)) if patterns else F.lit(False)


def contains(base: Column, path: Column) -> Column:
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def included(nodes: DataFrame, includes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes(path) within any of the paths, and the paths (include) that none is within; nothing is joined."""
    inside = [contains(F.lit(p), F.col("path")) for p in includes]
    any_of = reduce(lambda a, b: a | b, inside, F.lit(False))
    hit = [F.when(~F.coalesce(F.bool_or(c), F.lit(False)), F.lit(p)) for c, p in zip(inside, includes, strict=True)]
    lost = nodes.agg(F.array_compact(F.array(*hit)).cast("array<string>").alias("lost")).select(F.explode(F.array_distinct("lost")).alias("include"))
    return nodes.where(any_of), lost


def safe_key(key: Column | str) -> Column:
    """Not empty, no backslash, not absolute, and no segment that is empty, `.` or `..`."""
    key = col(key)
    parts = F.split(key, "/")
    return (key != "") & ~key.contains("\\") & ~key.startswith("/") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def safe_name(name: Column | str) -> Column:
    return col(name).rlike(SAFE_NAME)


def unsafe_node(name: Column | str, kind: Column | str, subtree: Column | str) -> Column:
    name = col(name)
    return name.isin("", ".", "..") | name.contains("/") | name.contains("\0") | (col(subtree).isNotNull() & (col(kind) != "dir"))


def join_prefix(*parts: Column | str) -> Column:
    """Parts joined by slashes, without empty ones and without slashes at their ends."""
    trimmed = [F.regexp_replace(F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")), "^/+|/+$", "") for p in parts]
    return F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in trimmed))


def site_of_key(key: Column | str, prefix: str) -> Column:
    """The site of backups/<site>/... below a prefix; null for others."""
    lead = prefix.strip("/")
    return F.nullif(F.regexp_extract(col(key), f"^{re.escape(lead) + '/' if lead else ''}([^/]+)/.+$", 1), F.lit(""))


def root_name(path: Column | str) -> Column:
    """The last name of a path; `root` for the root itself."""
    clean = F.regexp_replace(col(path), "/+$", "")
    return F.when(clean == "", "root").otherwise(F.substring_index(clean, "/", -1))


def repository_prefix(site: Column, server: Column, product: str = "backups", old: str = "repository") -> Column:
    """Where a site's repository lies: below the server's folder, or for repositories without one in the old folder."""
    return F.when(F.coalesce(server, F.lit("")) == "", join_prefix(F.lit(old), site)).otherwise(join_prefix(F.lit(product), server, site, F.lit("incremental-backup")))


def repository_url(storages: DataFrame, product: str = "backups", old: str = "repository") -> Column:
    """The location of a repository by storages(type, directory, bucket, endpoint, prefix, site, server); null if it can't be told."""
    text = lambda c: F.coalesce(storages[c], F.lit(""))
    below = repository_prefix(storages["site"], storages["server"], product, old)
    end = F.regexp_replace(text("endpoint"), "/+$", "")
    host = F.when(end == "", "s3.amazonaws.com").when(end.rlike("^https?://"), end).otherwise(F.concat(F.lit("https://"), end))
    local = F.concat(F.regexp_replace(text("directory"), "/+$", ""), F.lit("/"), below)
    remote = F.concat(F.lit("s3:"), host, F.lit("/"), text("bucket"), F.lit("/"), join_prefix(text("prefix"), below))
    told = text("site") != ""
    return F.when(told & (storages["type"] == "local") & (text("directory") != ""), local).when(told & storages["type"].isin("s3", "r2") & (text("bucket") != ""), remote)
