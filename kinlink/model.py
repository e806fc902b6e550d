"""Records and scored pairs, and views of the driver's tables as such.

A record has id, country, src (1: the clean list; 2, 3: the noisy ones), name and address. A scored
pair has s1, src, rec, country, p. Ids are real keys; nothing depends on the position of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fraction(salt: str, *cols: str) -> Column:
    """Stable fraction in [0, 1): the first 8 hexadecimal digits of md5(salt|key|...) over 2**32."""
    text = F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def lowered(x: Column) -> Column:
    """Lower case letter by letter, as in the SQL: Java makes two letters of İ, and another letter of a Σ at the end of a word."""
    return F.when(F.contains(x, F.lit("\u0130")) | F.contains(x, F.lit("\u03a3")), F.lower(F.translate(x, "\u0130\u03a3", "i\u03c3"))).otherwise(F.lower(x))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: language as country, source number mod 3 as list, first line as name, the rest as address."""
    lower = lowered(F.coalesce("text", F.lit("")))
    name = F.substring_index(lower, "\n", 1)
    address = F.substring(lower, F.char_length(name) + 2, F.char_length(lower))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("country"),
        (F.substring("source", 4, 9).cast("int") % 3 + 1).alias("src"),
        name.alias("name"),
        address.alias("address"),
        F.regexp_extract_all(name, F.lit(f"({TOKEN})")).alias("name_toks"),
        F.regexp_extract_all(address, F.lit(f"({TOKEN})")).alias("addr_toks"),
    )


RECORDS_SQL = """rec AS (
  SELECT doc_id AS id, lang AS country, CAST(substr(source, 4) AS INT) % 3 + 1 AS src, split_part(lower(text), chr(10), 1) AS name,
         substr(lower(text), length(split_part(lower(text), chr(10), 1)) + 2) AS address,
         regexp_extract_all(split_part(lower(text), chr(10), 1), '[a-z0-9]+') AS name_toks,
         regexp_extract_all(substr(lower(text), length(split_part(lower(text), chr(10), 1)) + 2), '[a-z0-9]+') AS addr_toks
  FROM documents)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and supplier pairs as candidates of a record and a clean entity, with made-up scores p, q and truth y."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s1"), F.col("s_nationkey").alias("country"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_suppkey").alias("s1")).distinct().join(nations, "s1")
    pairs = pairs.withColumn("src", (F.col("rec") % 2 + 2).cast("int"))
    return pairs.select("s1", "src", "rec", "country", fraction("p", "rec", "s1").alias("p"), fraction("q", "rec", "s1").alias("q"), (fraction("y", "rec", "s1") < fraction("p", "rec", "s1")).cast("int").alias("y"))


def _sql_fraction(salt: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}|' || rec || '|' || s1), 1, 8) AS BIGINT) / 4294967296.0"


PAIRS_SQL = f"""pairs AS (
  SELECT s1, CAST(rec % 2 + 2 AS INT) AS src, rec, s_nationkey AS country, {_sql_fraction("p")} AS p, {_sql_fraction("q")} AS q,
         CASE WHEN {_sql_fraction("y")} < {_sql_fraction("p")} THEN 1 ELSE 0 END AS y
  FROM (SELECT DISTINCT l_orderkey AS rec, l_suppkey AS s1 FROM lineitem) JOIN supplier ON s_suppkey = s1)"""
