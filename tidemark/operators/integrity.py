"""Repository checks: findings of nine kinds, index repair, blob verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.sealing import Keys, unseal_all
from tidemark.operators.graph import missing_blobs
from tidemark.sources.schemas import FINDINGS

KINDS = ("broken_key", "broken_config", "broken_index", "broken_snapshot", "missing_blob", "corrupt_blob", "missing_pack", "broken_pack", "orphaned_pack")


def finding(df: DataFrame, kind: str, **columns) -> DataFrame:
    """Rows of FINDINGS; columns that aren't given are null."""
    import re

    fields = re.findall(r"(\w+) (\w+)", FINDINGS)
    return df.select(*(F.lit(kind).alias(n) if n == "type" else columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def merged_blobs(entries: DataFrame) -> DataFrame:
    """What all indexes together say of each pack, each blob once."""
    return entries.dropDuplicates(["pack_id", "id", "offset", "length"])


def undecodable(files: DataFrame) -> DataFrame:
    """files(kind, id, status) whose status isn't ok: keys, configurations, indexes, snapshots."""
    bad = files.where("status <> 'ok'")
    rows = finding(bad, "broken_", id=F.col("id"), detail=F.col("status"), pack_id=F.col("kind"))
    return rows.withColumn("type", F.concat("type", "pack_id")).withColumn("pack_id", F.lit(None).cast("string"))


def broken_snapshots(snapshots: DataFrame) -> DataFrame:
    return finding(snapshots.where("tree IS NULL"), "broken_snapshot", id=F.col("id"), snapshot_id=F.col("id"), detail=F.lit("no tree"))


def missing_packs(entries: DataFrame, pack_files: DataFrame) -> DataFrame:
    gone = merged_blobs(entries).groupBy("pack_id").agg(F.count("*").alias("n")).join(pack_files, "pack_id", "left_anti")
    return finding(gone, "missing_pack", id=F.col("pack_id"), pack_id=F.col("pack_id"), blob_count=F.col("n"))


def orphaned_packs(entries: DataFrame, pack_files: DataFrame) -> DataFrame:
    """Stored packs that no index names; other files in the folder aren't packs."""
    orphans = pack_files.where(F.col("pack_id").rlike("^[0-9a-f]{64}$")).join(entries.select("pack_id"), "pack_id", "left_anti")
    return finding(orphans, "orphaned_pack", id=F.col("pack_id"), pack_id=F.col("pack_id"))


def broken_packs(entries: DataFrame, headers: DataFrame, pack_files: DataFrame) -> DataFrame:
    """Stored packs whose own list of blobs differs from the index's, in offset order; types aren't compared."""
    blob = F.struct("offset", "id", "length", F.coalesce("compressed", F.lit(False)).alias("compressed"), F.coalesce("uncompressed_length", F.lit(0)).alias("uncompressed_length"))
    listed = lambda df, name: df.groupBy("pack_id").agg(F.sort_array(F.collect_list(blob)).alias(name))
    indexed = listed(merged_blobs(entries).withColumn("compressed", F.coalesce("uncompressed_length", F.lit(0)) > 0), "want")
    own = listed(headers, "have")
    bad = indexed.join(pack_files.select("pack_id"), "pack_id", "left_semi").join(own, "pack_id", "left").where(~F.col("want").eqNullSafe(F.col("have")))
    return finding(bad, "broken_pack", id=F.col("pack_id"), pack_id=F.col("pack_id"), detail=F.when(F.col("have").isNull(), "header unreadable").otherwise("header differs from index"))


def missing(snapshots: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    return finding(missing_blobs(snapshots, nodes, entries), "missing_blob", id=F.col("id"), snapshot_id=F.col("snapshot_id"), detail=F.col("type"))


def corrupt(blobs: DataFrame) -> DataFrame:
    """Blobs(id, pack_id, data) whose bytes don't hash to their id; packed ones are expanded first (see unpack)."""
    bad = blobs.where(F.col("data").isNull() | (F.sha2("data", 256) != F.col("id")))
    return finding(bad, "corrupt_blob", id=F.col("id"), pack_id=F.col("pack_id"), detail=F.when(F.col("data").isNull(), "unreadable").otherwise("hash differs"))


def unpack(entries: DataFrame, packs: DataFrame, keys: Keys | None = None) -> DataFrame:
    """entries with data: the bytes at their place in packs(pack_id, content), opened with keys if the repository
    is sealed, and expanded if compressed; null if they are outside of the pack, don't open or don't expand."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            raw = batch.column("data").to_pylist()
            for plain, full in zip(unseal_all(raw, keys) if keys else raw, batch.column("uncompressed_length").to_pylist(), strict=True):
                try:
                    out.append(expand.decompress(plain, max_output_size=full) if plain is not None and full else plain)
                except zstandard.ZstdError:
                    out.append(None)
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    inside = (F.col("offset") >= 0) & (F.col("offset") + F.col("length") <= F.length("content"))
    cut = entries.join(packs, "pack_id").withColumn("data", F.when(inside, F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int")))).drop("content")
    return cut.mapInArrow(run, cut.schema)


def check(snapshots: DataFrame, nodes: DataFrame, entries: DataFrame, headers: DataFrame, pack_files: DataFrame, files: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """All findings, by kind and id; files adds decode states, blobs the check of every blob's bytes."""
    parts = [broken_snapshots(snapshots), missing(snapshots, nodes, entries), missing_packs(entries, pack_files), broken_packs(entries, headers, pack_files), orphaned_packs(entries, pack_files)]
    if files is not None:
        parts.append(undecodable(files))
    if blobs is not None:
        parts.append(corrupt(blobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("type", "id")


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("findings"))


def line():
    """A finding as a line of text: its kind, its id and what the kind adds."""
    where = lambda word, c: F.concat(F.lit(f" ({word} "), F.coalesce(c, F.lit("")), F.lit(")"))
    own = F.concat("type", F.lit(" "), F.coalesce("id", F.lit("")))
    packed = F.coalesce("pack_id", F.lit("")) != ""
    return (
        F.when(F.col("type") == "broken_config", "broken_config config").when(F.col("type") == "missing_blob", F.concat(own, where("snapshot", F.col("snapshot_id"))))
        .when((F.col("type") == "corrupt_blob") & packed, F.concat(own, where("pack", F.col("pack_id")))).when(F.col("type") == "corrupt_blob", F.concat(own, where("snapshot", F.col("snapshot_id"))))
        .when(F.col("type") == "missing_pack", F.concat(own, F.lit(" ("), F.coalesce("blob_count", F.lit(0)).cast("string"), F.lit(" blobs)"))).otherwise(own)
    )


def report_lines(findings: DataFrame, most: int = 100) -> DataFrame:
    """Findings as a person reads them: (position, line) of the first `most` by kind and id, then how many more there are."""
    first = findings.select("type", "id", line().alias("line")).orderBy("type", "id", "line").limit(most)
    shown = first.select(F.row_number().over(W.orderBy("type", "id", "line")).alias("position"), "line")  # at most `most` rows
    more = findings.agg(F.count("*").alias("n")).where(F.col("n") > most)
    rest = more.select(F.lit(most + 1).alias("position"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more findings (see --findings-file)")).alias("line"))
    return shown.unionByName(rest)


def check_summary(findings: DataFrame, site: str, destination: str) -> DataFrame:
    """One row, line: `check site/destination: healthy`, or how many findings of each kind there are, in the order of kinds."""
    kinds = by_type(findings).agg(F.sort_array(F.collect_list(F.struct("type", "findings"))).alias("kinds"))  # nine kinds at most
    told = F.array_join(F.transform("kinds", lambda k: F.concat(k["findings"].cast("string"), F.lit(" "), k["type"])), ", ")
    words = F.when(F.size("kinds") == 0, "healthy").otherwise(F.concat(F.lit("problems found ("), told, F.lit(")")))
    return kinds.select(F.concat(F.lit(f"check {site}/{destination}: "), words).alias("line"))


def write_findings(findings: DataFrame, path: str, output: str = "text") -> None:
    """All findings at a path, even if there are none: a line for each, or as JSON a record for each."""
    ordered = findings.sort("type", "id")
    if output == "json":
        ordered.write.mode("overwrite").json(path)
    else:
        ordered.select(line().alias("line")).write.mode("overwrite").text(path)


def new_packs(newer: DataFrame, older: DataFrame) -> DataFrame:
    """pack_id of all packs that the newer list has and the older one lacks, each once."""
    return newer.select("pack_id").subtract(older.select("pack_id"))


def counters(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_distinct("index_id").alias("index_files"), F.count_distinct("pack_id").alias("packs"), F.count_distinct("type", "id").alias("blobs")).crossJoin(snapshots.agg(F.count("*").alias("snapshots")))


def repair_index(headers: DataFrame, pack_files: DataFrame, header_bytes: int = 37, fixed: int = 0) -> DataFrame:
    """A new index from the packs' own lists; the query fails if any pack's list doesn't fit its file.

    A list fits if its blobs lie one after the other and, with the entries themselves, take no more than
    the file.
    """
    w = W.partitionBy("pack_id").orderBy("offset", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    placed = headers.withColumn("__at", F.coalesce(F.sum("length").over(w), F.lit(0)))
    state = placed.groupBy("pack_id").agg(F.bool_and(F.col("__at") == F.col("offset")).alias("gapless"), (F.sum("length") + F.count("*") * header_bytes + fixed).alias("needs"))
    judged = pack_files.join(state, "pack_id", "left").withColumn("fits", F.coalesce(F.col("gapless") & (F.col("needs") <= F.col("size")), F.lit(False)))
    whole = judged.agg(F.bool_and("fits").alias("all_fit"))
    rows = headers.join(pack_files.select("pack_id"), "pack_id", "left_semi").crossJoin(F.broadcast(whole))  # whole is one row
    return rows.where(F.assert_true("all_fit", "a pack's list of blobs does not fit its file; nothing was changed").isNull()).select("pack_id", "type", "id", "offset", "length", "uncompressed_length")
