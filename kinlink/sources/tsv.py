"""Tab-separated sources and results: all strings, no quoting, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by the header's names, so their order in the file does not matter."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False, enforceSchema=False)
    wanted = [x.split()[0] for x in schema.split(",")]
    return raw.select(*(F.col(c).cast("string") for c in wanted))


def records(spark: SparkSession, path: str, src: int) -> DataFrame:
    """id, country, src, name, address; missing names and addresses are empty."""
    r = read(spark, path, RECORD)
    return r.select(F.col("entity_id").alias("id"), "country", F.lit(src).alias("src"), F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"))


def records_of(records_: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose ids are needed (column id of ``ids``)."""
    return records_.join(ids.select("id").distinct(), "id", "left_semi")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1, rec): one row for each true pair; entities without matches give none."""
    t = read(spark, path, TRUTH).select(F.col("source1_entity_id").alias("s1"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("rec"))
    return t.filter(F.col("rec") != "")


def write_lists(lists: DataFrame, path: str, key: str, values: str, names: tuple[str, str] = ("source1_entity_id", "matched_entity_ids"), order: str | None = None) -> None:
    """One line for each entity, ordered by entity over the part files; empty lists stay. With ``order``, by that column, say the place in a source file."""
    out = lists.select(F.col(order or key).alias("_o"), F.col(key).cast("string").alias(names[0]), F.coalesce(F.col(values), F.lit("")).alias(names[1]))
    out.orderBy("_o", names[0]).drop("_o").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def sample(records_: DataFrame, truth_: DataFrame, fraction: float) -> DataFrame:
    """A share of the clean entities by hash, all their matches, and the same share of unmatched noisy records."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("sample"), F.col("id"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    clean = records_.filter((F.col("src") == 1) & (u < fraction))
    own = truth_.join(clean.select(F.col("id").alias("s1")), "s1", "left_semi").select(F.col("rec").alias("id"))
    noisy = records_.filter(F.col("src") != 1)
    free = noisy.join(truth_.select(F.col("rec").alias("id")), "id", "left_anti").filter(u < fraction)
    return clean.unionByName(noisy.join(own, "id", "left_semi")).unionByName(free)


def missing_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates; there should be none."""
    return matches.join(candidates, ["s1", "src", "rec"], "left_anti")
