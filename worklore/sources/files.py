"""File store records to documents; folder paths and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.text import first_set
from worklore.operators.joins import left_join_where
from worklore.session import materialize

# Fixed values.
FOLDER_TYPE = "application/vnd.google-apps.folder"
MEDIA_PREFIXES = ["image/", "video/", "audio/"]
BLOCKED_TYPES = [
    "application/zip", "application/x-zip-compressed", "application/x-compress", "application/x-compressed",
    "application/octet-stream", "application/x-tar", "application/x-gzip", "application/x-bzip2", "application/x-7z-compressed",
]
MAX_BYTES = 20 * 1024 * 1024


def file_type(mime: Column) -> Column:
    return (
        F.when(mime.contains("document") | mime.contains("text"), "document")
        .when(mime.contains("spreadsheet"), "spreadsheet")
        .when(mime.contains("presentation"), "presentation")
        .when(mime == "application/pdf", "pdf")
        .otherwise("other")
    )


def mime_gate(df: DataFrame, mime: str = "mime_type", body: str = "body") -> DataFrame:
    """Drop media, archives, binary and huge bodies; flag HTML for conversion."""
    m, b = F.col(mime), F.col(body)
    media = F.lit(False)
    for prefix in MEDIA_PREFIXES:
        media = media | m.startswith(prefix)
    kept = df.filter(~media & ~m.isin(BLOCKED_TYPES) & (F.octet_length(b) <= MAX_BYTES) & (F.instr(b, "\x00") == 0))
    low = F.lower(b)
    return kept.withColumn("is_html", (m == "text/html") | low.contains("<html") | low.contains("<body"))


def folder_chains(folders: DataFrame) -> DataFrame:
    """(folder_id, chain): the folder and its parents up to the root, by id and name.

    Chains double in each round: a chain is continued by the chain of the folder
    it stops at, so a tree of depth d takes log2(d) joins.  A chain stops before
    a folder it already holds.
    """
    state = folders.select(
        "folder_id",
        F.array(F.struct(F.col("folder_id").alias("id"), "name")).alias("chain"),
        F.when(F.col("parent_id") != F.col("folder_id"), F.col("parent_id")).alias("next"),
    )
    while True:
        more = state.select(F.col("folder_id").alias("next"), F.col("chain").alias("_c"), F.col("next").alias("_n"))
        joined = left_join_where(state, more, "next", F.col("next").isNotNull())
        ids, more_ids = F.col("chain.id"), F.col("_c.id")
        met = F.get(F.array_intersect(more_ids, ids), F.lit(0))
        # the continuation up to the first folder already in the chain
        added = F.when(met.isNotNull(), F.slice("_c", F.lit(1), F.array_position(more_ids, met).cast("int") - 1)).otherwise(F.col("_c"))
        closed = met.isNotNull() | F.array_contains(F.concat(ids, more_ids), F.col("_n"))
        state = joined.select(
            "folder_id",
            F.when(F.col("_c").isNotNull(), F.concat("chain", added)).otherwise(F.col("chain")).alias("chain"),
            F.when(~closed, F.col("_n")).alias("next"),
        )
        state = materialize(state, "chains")
        if state.filter(F.col("next").isNotNull()).isEmpty():
            return state.drop("next")


def folder_paths(chains: DataFrame) -> DataFrame:
    """(folder_id, path): names from the root down, joined by a slash."""
    names = F.reverse(F.transform("chain", lambda x: x["name"]))
    return chains.select("folder_id", F.array_join(names, "/").alias("path"))


def descendants(chains: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct folders at or under any of the roots."""
    up = chains.select("folder_id", F.explode("chain").alias("a")).select("folder_id", F.col("a.id").alias("root_id"))
    return up.join(roots.select("root_id"), "root_id", "left_semi").select("folder_id").distinct()


def files(raw: DataFrame, paths: DataFrame) -> DataFrame:
    """Files to documents with their path; ``paths`` is (folder_id, path)."""
    home = paths.select(F.col("folder_id").alias("_parent"), F.col("path").alias("_home"))
    rows = left_join_where(raw.withColumn("_parent", F.get("parents", F.lit(0))), home, "_parent", F.col("_parent").isNotNull())
    path = F.concat(F.coalesce(F.concat(F.lit("/"), "_home"), F.lit("")), F.lit("/"), "name")
    folder = F.regexp_extract(path, r"\A([\s\S]+)/[^/]*\z", 1)
    return rows.select(
        F.concat(F.lit("drive_"), "id").alias("id"),
        F.lit("drive").alias("source"),
        file_type(F.col("mimeType")).alias("type"),
        F.col("name").alias("title"),
        F.concat(F.lit("File: "), "name", F.lit("\nPath: "), path, F.lit("\n\n"), "body").alias("content"),
        "name",
        F.col("mimeType").alias("mime_type"),
        path.alias("path"),
        first_set(folder, F.lit("/")).alias("folder_path"),
        first_set(F.get("owners", F.lit(0))["displayName"], F.lit("Unknown")).alias("owner"),
        F.try_to_timestamp("createdTime").alias("created_at"),
        F.try_to_timestamp("modifiedTime").alias("modified_at"),
        F.col("webViewLink").alias("url"),
    )


def file_scope(
    df: DataFrame,
    since: str | None = None,
    my_files: bool = False,
    shared_with_me: bool = False,
    starred: bool = False,
    my_folders: DataFrame | None = None,
    drive_folders: DataFrame | None = None,
) -> DataFrame:
    """Live files changed since, that any of the chosen scopes holds.

    The folder arguments are closures from ``descendants``.
    """
    df = df.filter((F.col("mime_type") != FOLDER_TYPE) & ~F.col("trashed"))
    if since:
        df = df.filter(F.col("modified_at") > F.lit(since).cast("timestamp"))
    scopes = []
    for flag, closure in (("_mine", my_folders if my_files else None), ("_shared", drive_folders)):
        if closure is not None:
            mark = closure.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias(flag))
            df = df.join(mark, "parent_id", "left")
            scopes.append(F.coalesce(flag, F.lit(False)))
    if my_files and my_folders is None:
        scopes.append(F.coalesce(F.col("parent_id") == "root", F.lit(False)) | F.col("owned_by_me"))
    if shared_with_me:
        scopes.append(F.col("shared_with_me"))
    if starred:
        scopes.append(F.col("starred"))
    if scopes:
        any_scope = scopes[0]
        for s in scopes[1:]:
            any_scope = any_scope | s
        df = df.filter(any_scope)
    return df.drop("_mine", "_shared")
