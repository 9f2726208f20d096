"""Domain tables as views over a star schema, as SQL that Spark and DuckDB read alike.

Each view names the tables and views that it needs; {date}, {sha} and the like are what the two dialects
spell differently.  `view` gives a DataFrame, `with_clause` the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "long_date": "date_format({0}, 'dd-MMMM-yyyy')", "short_date": "date_format({0}, 'yyyy-MM-dd')", "dots": "date_format({0}, 'HH.mm.ss')", "dashes": "date_format({0}, 'HH-mm-ss')",
    "sha": "sha2({0}, 256)", "list": "array({0})", "unnest": "explode({0})", "bytes": "octet_length({0})", "pad8": "lpad({0}, 8, '0')",
}
DUCKDB = {
    "long_date": "strftime({0}, '%d-%B-%Y')", "short_date": "strftime({0}, '%Y-%m-%d')", "dots": "strftime({0}, '%H.%M.%S')", "dashes": "strftime({0}, '%H-%M-%S')",
    "sha": "sha256({0})", "list": "[{0}]", "unnest": "unnest({0})", "bytes": "strlen({0})", "pad8": "lpad({0}, 8, '0')",
}

#: name -> (needs, SQL); what stands as @word(argument) is spelled by the dialect.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "runs": (("orders",), """
        SELECT id, seq, site_name, scope, status, forced, started_at,
               CASE WHEN status <> 'running' THEN started_at + INTERVAL '1' SECOND * CAST(floor(duration_millis / 1000) AS BIGINT) END AS finished_at,
               duration_millis, CASE WHEN status = 'failed' THEN 'source' WHEN seq % 13 = 0 THEN 'retention' ELSE '' END AS error_category,
               CASE WHEN status = 'failed' OR seq % 13 = 0 THEN 'message ' || id ELSE '' END AS error_message
        FROM (SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS seq, 'site-' || CAST(o_custkey % 50 AS STRING) AS site_name,
                     CASE WHEN o_orderpriority = '5-LOW' THEN 'database_only' ELSE 'full' END AS scope,
                     CASE WHEN o_orderstatus = 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'partial' ELSE 'skipped' END
                          WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'cancelled' ELSE 'success' END
                          ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'no_change' ELSE 'success' END END AS status,
                     o_orderkey % 7 = 0 AS forced, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS started_at,
                     CAST(floor(o_totalprice) AS BIGINT) AS duration_millis FROM orders) r"""),
    "packages": (("lineitem",), """
        SELECT CAST(l_orderkey AS STRING) AS run_id, CASE l_returnflag WHEN 'N' THEN 'files' ELSE 'database' END AS source_kind, 'src-' || CAST(l_partkey % 3 AS STRING) AS source_name,
               'dest-' || CAST(l_suppkey % 4 AS STRING) AS destination, CAST(floor(l_extendedprice * 100) AS BIGINT) AS size,
               CASE WHEN l_discount >= 0.095 THEN 'failed' ELSE 'stored' END AS status,
               'key-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS object_key,
               CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem"""),
    "sites": (("nation",), """
        SELECT 'site-' || CAST(n_nationkey AS STRING) AS name, n_nationkey % 6 <> 5 AS enabled, CASE n_regionkey % 2 WHEN 0 THEN 'full' ELSE 'incremental' END AS backup_mode, 1 + n_nationkey % 4 AS keep_last FROM nation"""),
    "storages": (("region",), """
        SELECT 'dest-' || CAST(r_regionkey AS STRING) AS name, CASE r_regionkey % 2 WHEN 0 THEN 's3' ELSE 'local' END AS type FROM region WHERE r_regionkey < 4"""),
    "site_destinations": (("nation", "region"), """
        SELECT 'site-' || CAST(n_nationkey AS STRING) AS site_name, 'dest-' || CAST(r_regionkey AS STRING) AS destination FROM nation, region WHERE (n_nationkey + r_regionkey) % 2 = 0"""),
    "event_runs": (("events",), """
        SELECT CAST(event_id AS STRING) AS id, 'site-' || CAST(user_id AS STRING) AS site_name, CASE WHEN event_id % 5 = 2 THEN 'database_only' ELSE 'full' END AS scope,
               CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'partial' END AS status,
               event_id % 7 = 0 AS forced, ts AS started_at FROM events"""),
    "objects": (("runs",), """
        SELECT destination, site_name, CASE seq % 4 WHEN 0 THEN @long_date(started_at) || '/' || @dots(started_at) || '-' || run || '-' || name WHEN 1 THEN @long_date(started_at) || '/' || @dashes(started_at) || '-' || run || '-' || name
                    WHEN 2 THEN @short_date(started_at) || '/' || @dashes(started_at) || '-' || name ELSE CASE WHEN seq % 8 = 3 THEN @short_date(started_at) || '/' || @dots(started_at) || '-' || name ELSE @long_date(started_at) || '/' || @dots(started_at) || '-' || run || '-' || name END END AS key, size
        FROM (SELECT r.*, @pad8(id) AS run, 'dest-' || CAST(seq % 2 AS STRING) AS destination, n.name, n.weight * duration_millis AS size
              FROM runs r, (SELECT 'files.tar.gz' AS name, 3 AS weight UNION ALL SELECT 'src-1.sql.gz', 2 UNION ALL SELECT '.backup-complete', 0) n
              WHERE status IN ('success', 'partial') AND (name <> '.backup-complete' OR status = 'success' AND seq % 5 <> 0)) o"""),
    "files": (("documents",), """
        SELECT doc_id, '/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) AS path, '/' || source || '/' || lang AS parent, source, lang, @sha(text) AS id, CAST(@bytes(text) AS BIGINT) AS size, text FROM documents"""),
    "snapshots": (("region",), """
        SELECT 'snap-' || CAST(r_regionkey AS STRING) AS id, r_regionkey AS k, CAST('2026-01-01' AS DATE) + INTERVAL '1' DAY * r_regionkey AS time, 'root-' || CAST(r_regionkey AS STRING) AS tree,
               CASE WHEN r_regionkey % 2 = 0 THEN 'site:a' ELSE 'site:b' END AS tag, CASE WHEN r_regionkey < 3 THEN '/srv' ELSE '/opt' END AS root FROM region"""),
    # snapshot k holds the documents whose id leaves at most k when divided by 5; directories are trees of their own
    "snapshot_files": (("files", "snapshots"), "SELECT s.id AS snapshot_id, s.k, f.doc_id, f.path, f.source, f.lang, f.id, f.size FROM files f, snapshots s WHERE f.doc_id % 5 <= s.k"),
    "edges": (("snapshot_files",), """
        SELECT DISTINCT 'root-' || CAST(k AS STRING) AS tree, 'dir-' || source || '-' || CAST(k AS STRING) AS subtree FROM snapshot_files
        UNION SELECT DISTINCT 'dir-' || source || '-' || CAST(k AS STRING), 'leaf-' || source || '-' || lang FROM snapshot_files WHERE lang <> 'de' OR k >= 2"""),
    "leaf_content": (("files",), "SELECT DISTINCT 'leaf-' || source || '-' || lang AS tree, id FROM files WHERE doc_id % 5 <= 3"),
    "blobs": (("files",), "SELECT 'data' AS type, id, size AS length, doc_id, 'pack-' || substring(id, 1, 2) AS pack_id FROM files"),
    "index_entries": (("files",), "SELECT DISTINCT 'ix-' || substring(id, 1, 1) AS index_id, 'pack-' || substring(id, 1, 2) AS pack_id, 'data' AS type, id, size AS length FROM files WHERE substring(id, 3, 1) <> '7'"),
    "pack_files": (("files",), "SELECT pack_id, CAST(sum(size) AS BIGINT) AS size FROM (SELECT DISTINCT 'pack-' || substring(id, 1, 2) AS pack_id, id, size FROM files WHERE substring(id, 2, 1) <> '5') p GROUP BY pack_id"),
    "locks": (("runs",), """
        SELECT site_name, CAST(substring(site_name, 6) AS INT) % 3 <> 0 AS verified, CAST(1000 + CAST(substring(site_name, 6) AS INT) % 20 AS BIGINT) AS pid, started_at + INTERVAL '1' SECOND * (CAST(substring(site_name, 6) AS INT) % 2) AS acquired_at
        FROM (SELECT site_name, max(started_at) AS started_at FROM runs WHERE status = 'running' GROUP BY site_name) l WHERE CAST(substring(site_name, 6) AS INT) < 30"""),
    "tables": (("part",), "SELECT CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'db.' END || CASE WHEN p_partkey % 20 = 0 THEN 'old.' ELSE '' END || CAST(p_partkey AS STRING) AS full_name, CASE WHEN p_partkey % 20 = 0 THEN 'old.' ELSE '' END || CAST(p_partkey AS STRING) AS name, p_partkey AS position, CASE p_partkey % 4 WHEN 0 THEN 'InnoDB' WHEN 1 THEN 'MyISAM' WHEN 2 THEN 'Aria' ELSE 'aria' END AS engine, p_size, p_partkey FROM part"),
}


def _spelled(sql: str, dialect: dict[str, str]) -> str:
    out, i = "", 0
    while (at := sql.find("@", i)) >= 0:
        name_end = sql.index("(", at)
        depth, end = 1, name_end + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[i:at] + dialect[sql[at + 1 : name_end]].format(sql[name_end + 1 : end - 1])
        i = end
    return out + sql[i:]


def needed(*names: str) -> list[str]:
    """The views themselves after all views that they need."""
    out: list[str] = []
    for name in names:
        if name in VIEWS:
            out += [x for x in (*needed(*VIEWS[name][0]), name) if x not in out]
    return out


def with_clause(*names: str) -> str:
    """WITH ... for DuckDB."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_spelled(VIEWS[n][1], DUCKDB)})" for n in needed(*names)) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a view as a DataFrame; nothing is registered in the session."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    args = {n: view(spark, sf_dir, n) for n in VIEWS[name][0]}
    sql = _spelled(VIEWS[name][1], SPARK)
    import re

    for n in args:
        sql = re.sub(rf"(?<=[\s,]){n}(?=[\s,)]|$)", "{" + n + "}", sql)
    return spark.sql(sql, **args)
