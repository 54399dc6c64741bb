"""JSON of any shape and depth as rows, by Spark's VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written

#: Scripts that hold linked data.
LINKED = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script\s*>"


def leaves(df: DataFrame, id_col: str, json_col: str, deepest: int = 1000) -> DataFrame:
    """(id_col, path array<string>, name, kind, value): every value of a JSON text that is neither an object nor a list.

    ``path`` has the keys, and places in lists as ten digits, so that paths sort in the order of places and else of keys (a VARIANT keeps the keys of an object in that order); ``name`` is the nearest key;
    ``kind`` the type's name in lower case; a JSON null has the kind ``void`` and no value.  Empty objects and lists have no leaf.  Text that isn't JSON, and null, have none either.  A level of nesting is one step,
    whose containers are written for the next; deeper than ``deepest`` is an error.  Ids may repeat.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    level = df.select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
    kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), "^([A-Za-z]+)", 1))
    out = None
    for k in range(deepest + 1):
        level = written(level.withColumn("kind", kind), folder, f"level{k}")
        own = level.where("kind not in ('object', 'array')").select("id", "path", "name", "kind", F.col("v").cast("string").alias("value"))
        out = own if out is None else out.union(own)
        inside = level.where("kind in ('object', 'array')")
        if inside.isEmpty():
            return out.withColumnRenamed("id", id_col)
        level = spark.sql("SELECT x.id, concat(x.path, array(coalesce(e.key, lpad(cast(e.pos AS string), 10, '0')))) AS path, coalesce(e.key, x.name) AS name, e.value AS v FROM {x} x, LATERAL variant_explode(x.v) e", x=inside)
    raise ValueError(f"JSON of more than {deepest} levels")


def flattened(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, text): all values of a JSON text, one a line, in the order of their paths; nulls are left out.  Ids are distinct; one without values isn't there."""
    rows = leaves(df, id_col, json_col).where("value is not null")
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]), "\n").alias("text"))


def linked_data(html: Column) -> Column:
    """The JSON texts of a page's scripts of linked data."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINKED), F.lit(1))


def article_bodies(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, body): every articleBody that is a text, at any depth of a page's linked data."""
    scripts = pages.where(F.col(html_col).contains("ld+json")).select(F.col(id_col).alias("id"), F.explode(linked_data(F.col(html_col))).alias("j"))
    return leaves(scripts, "id", "j").where("kind = 'string' and element_at(path, -1) = 'articleBody'").select(F.col("id").alias(id_col), F.col("value").alias("body"))
