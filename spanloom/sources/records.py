"""Readers and writers of record sets, and the adapter from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import keys as K
from spanloom.functions import normalise as N

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated file with a header; missing fields are empty.

    Columns are taken by the header's names; a byte-order mark before the
    first is tolerated, a missing column fails at once.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema))


def read_records(spark: SparkSession, path: str, source: str, profile: str = "v2", limit: int | None = None) -> DataFrame:
    """Keyed records of a file, or of its first ``limit`` rows."""
    raw = read_tsv(spark, path)
    return K.add_keys((raw.limit(limit) if limit is not None else raw).withColumn("source", F.lit(source)).withColumn("country", N.country(F.col("country"))), profile)


def explode_truth(truth: DataFrame) -> DataFrame:
    """Distinct (source1_entity_id, matched_entity_id) from comma lists; blanks are dropped."""
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.where(F.trim("source1_entity_id") != "").select(F.trim("source1_entity_id").alias("source1_entity_id"), F.explode(ids).alias("matched_entity_id")).distinct()


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, data_type) of every column, without reading a row."""
    rows = [(name, i, c, t) for name, df in tables.items() for i, (c, t) in enumerate(df.dtypes, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal long, column_name string, data_type string")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def adapt_documents(docs: DataFrame) -> DataFrame:
    """Three noisy copies of each document as business-style records of sources S1, S2 and S3.

    Words 1 to 4 are the name and 5 to 12 the address behind a number; each
    copy has a perturbation by doc_id (reversed name, first word dropped, blank
    address, added stop word and other number, two words with the address
    reversed, none).
    """
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{P}\p{S}]", " ")), r"\s+"), lambda t: t != "")
    base = docs.select("doc_id", F.upper(F.trim("lang")).alias("country"), words.alias("tk")).select(
        "doc_id", "country", F.slice("tk", 1, 4).alias("nm"), F.slice("tk", 5, 8).alias("ad"), (F.size("tk") % 97).cast("long").alias("num")
    )
    half = F.floor(F.col("doc_id") / 2)
    copies = F.array(
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("S1").alias("source"), F.lit(0).cast("long").alias("m"))),
        F.when(F.col("doc_id") % 3 != 0, F.struct(F.lit("S2").alias("source"), (half % 6).cast("long").alias("m"))),
        F.when(F.col("doc_id") % 5 < 3, F.struct(F.lit("S3").alias("source"), ((half + 3) % 6).cast("long").alias("m"))),
    )
    rows = base.withColumn("x", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select("*", "x.source", "x.m")
    m, nm, ad = F.col("m"), F.col("nm"), F.col("ad")
    join = lambda a: F.array_join(a, " ")
    name = F.when(m == 1, join(F.reverse(nm))).when(m == 2, join(F.slice(nm, 2, 3))).when(m == 4, F.concat_ws(" ", F.when(F.size(nm) > 0, join(nm)), F.lit("company"))).when(m == 5, join(F.slice(nm, 1, 2))).otherwise(join(nm))
    address = F.when(m == 3, "").otherwise(F.concat_ws(" ", (F.col("num") + F.when(m == 4, 1).otherwise(0)).cast("string"), F.when(F.size(ad) > 0, join(F.when(m == 5, F.reverse(ad)).otherwise(ad)))))
    return rows.select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("entity_id"), "source", "doc_id", "country", name.alias("business_name"), address.alias("business_address"))
