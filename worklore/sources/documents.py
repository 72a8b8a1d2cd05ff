"""The common document table, and its Markdown form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.text import first_set


def all_docs(*parts: DataFrame) -> DataFrame:
    """All normalised tables in one; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _json(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(value)), r"\A\[|\]\z", "")


def front_matter(df: DataFrame, cols: list[str]) -> Column:
    """``key: value`` lines, values as JSON, arrays in brackets, nulls left out."""
    lines = []
    for name in cols:
        kind = df.schema[name].dataType.typeName()
        if kind == "array":
            value = F.concat(F.lit("["), F.array_join(F.transform(name, _json), ", "), F.lit("]"))
        elif kind == "struct":
            value = F.to_json(name)
        elif kind.startswith("timestamp"):
            value = _json(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        else:
            value = _json(F.col(name))
        lines.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws("\n", *lines)


def file_name(doc_id: Column) -> Column:
    return F.concat(F.regexp_replace(doc_id, "[^a-zA-Z0-9_-]", "_"), F.lit(".md"))


def markdown(docs: DataFrame, meta: list[str]) -> DataFrame:
    """(source, file_name, body) of every document."""
    body = F.concat(
        F.lit("---\n"), front_matter(docs, meta), F.lit("\n---\n\n# "), first_set(F.col("title"), F.lit("Untitled")),
        F.lit("\n\n"), "content", F.lit("\n"),
    )
    return docs.select("source", file_name(F.col("id")).alias("file_name"), body.alias("body"))


def write_markdown(docs: DataFrame, path: str, meta: list[str], fmt: str = "parquet") -> None:
    """Rendered documents in one folder per source.

    Many documents share a file: one file each would be millions of small ones.
    """
    markdown(docs, meta).write.mode("append").partitionBy("source").format(fmt).save(path)
