"""Document fingerprints: SimHash by weighted votes, and search by permuted block tables; no Python per row.

Every word votes on 64 signed bits with a weight that grows with its length. Votes are sums of bits,
two 32-bit counters to a long: 32 sums per document hold all 64. For the search, a fingerprint is cut
into 6 blocks; two that differ in at most 3 bits agree in at least 3 blocks, so each of the 20 tables
keeps 3 blocks as an equality key, and candidates are compared in full.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RADIUS = 3
#: Bits of the blocks, RADIUS of which may differ while as many still agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Slots of neighbouring ids for each shuffle partition.
SLOTS = 4
SPACES = r"[\x20\x09-\x0D]+"
PAIR = (1 << 32) | 1


def votes(word: Column, weight: Column) -> list[Column]:
    """32 sums: bits k and k + 32 of the words' hashes, each in half a long."""
    h = F.xxhash64(word)
    return [F.sum(weight * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(PAIR))).alias(f"v{k}") for k in range(32)]


def weight_of(word: Column) -> Column:
    """0 for the empty word, else 1 to 16 by the square of the length.

    It stands in for a term's rarity: frequent words are short in every language, and a weight that comes
    from the word alone needs no count over all documents, so equal texts have equal fingerprints in any corpus.
    """
    n = F.least(F.char_length(word), F.lit(16)).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n * n / 16)))


def majority(total: Column) -> Column:
    """The fingerprint: bits whose votes weigh more than half of all."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"v{k}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        bit = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def with_fingerprints(texts: DataFrame, keep: list[str], text_cols: list[str]) -> DataFrame:
    """``keep`` and, for each text column c, ``c_fp``. Rows are told apart by a number within the task only."""
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(text_cols)))).alias("p")
    words = rows.select("_row", *keep, parts).select("_row", *keep, F.col("p.i").alias("_i"), F.explode(F.split("p.t", SPACES)).alias("w"))
    words = words.withColumn("m", weight_of(F.col("w")))
    # what is kept is a key, not first(): with a string among its buffers the aggregate would sort all words
    summed = words.groupBy("_row", "_i", *keep).agg(F.sum("m").alias("all"), *votes(F.col("w"), F.col("m")))
    prints = summed.select("_row", "_i", *keep, majority(F.col("all")).alias("fp"))
    if len(text_cols) == 1:
        return prints.select(*keep, F.col("fp").alias(f"{text_cols[0]}_fp"))
    out = prints.groupBy("_row", *keep).agg(
        *(F.max(F.when(F.col("_i") == i, F.col("fp"))).alias(f"{c}_fp") for i, c in enumerate(text_cols))
    )
    return out.drop("_row")


def slots(base: DataFrame, order: str, last: Column) -> tuple[Column, int]:
    """(slot of a row by its id, how many): slots hold about equally many rows, whatever the ids are.

    Edges are approximate quantiles, one for each slot, found by two short searches. ``last``: a hash by which
    rows with a null id are dealt to as many slots after the others.
    """
    count = SLOTS * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.array(*(F.lit(i / count) for i in range(1, count)))
    edges = sorted(set(base.agg(F.percentile_approx(order, at, F.lit(max(10_000, 20 * count)))).first()[0] or []))
    unnumbered = F.lit(len(edges) + 1).cast("long") + F.pmod(last, F.lit(count))
    if not edges:
        return F.coalesce(F.when(F.col(order).isNotNull(), F.lit(0)).cast("long"), unnumbered), 2 * count
    step = max(1, math.isqrt(len(edges)))
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    longs = lambda xs: F.array(*(F.lit(x) for x in xs))
    behind = lambda xs: F.size(F.filter(xs, lambda e: e <= F.col(order)))
    coarse = behind(longs([p[0] for p in parts]))
    fine = behind(F.element_at(F.array(*(longs(p) for p in parts)), F.greatest(coarse, F.lit(1))))
    found = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine).cast("long")
    return F.when(F.col(order).isNull(), unnumbered).otherwise(found), 2 * count


def with_next(rows: DataFrame, column: str, order: list[str], name: str = "next") -> DataFrame:
    """Adds ``name``: ``column`` of the row after it by ``slot`` and ``order`` (nulls last), for the last row the first's.

    Only first and last rows of slots are joined, one of each for a slot.
    """
    by_slot = Window.partitionBy("slot").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    ranked = rows.withColumn(name, F.lead(column).over(by_slot)).withColumn("_last", F.lead(F.lit(1)).over(by_slot).isNull()).withColumn("_first", F.lag(F.lit(1)).over(by_slot).isNull())
    first = ranked.filter("_first").select(F.col("slot").alias("_slot"), F.col(column).alias("_value"))
    every = Window.orderBy("_slot")  # one row for each slot
    follow = first.select("_slot", F.lead("_slot").over(every).alias("_then"), F.min("_slot").over(Window.partitionBy(F.lit(0))).alias("_begin"))
    follow = follow.select(F.col("_slot").alias("slot"), F.coalesce("_then", "_begin").alias("_slot"))
    last = ranked.filter("_last").join(follow.hint("merge"), "slot").join(first.hint("merge"), "_slot").select(*rows.columns, F.col("_value").alias(name))
    return ranked.filter(~F.col("_last")).select(*rows.columns, name).unionByName(last)


def block_masks() -> list[int]:
    out, at = [], 0
    for width in BLOCKS:
        out.append(((1 << width) - 1) << at)
        at += width
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """(q, fp): all pairs of a query fingerprint and a fingerprint within RADIUS bits, once each.

    Both inputs: one column ``fp`` of distinct longs. A pair is taken from the first table in which it
    agrees, so pairs are not repeated before they are compared.
    """
    masks, keep = block_masks(), len(BLOCKS) - RADIUS
    tables = list(combinations(range(len(BLOCKS)), keep))
    keys = F.explode(
        F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[b] for b in kept)))).alias("key")) for t, kept in enumerate(tables)))
    ).alias("k")
    left = queries.select(F.col("fp").alias("q"), keys).select("q", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    right = prints.select("fp", keys).select("fp", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(False)
    for t, kept in enumerate(tables):
        differ = [x.bitwiseAND(F.lit(_signed(masks[b]))) != 0 for b in range(max(kept)) if b not in kept]
        here = F.col("t") == t
        for d in differ:
            here = here & d
        first = first | here
    return left.join(right.hint("merge"), ["t", "key"]).filter((F.bit_count(x) <= RADIUS) & first).select("q", "fp")


def fingerprint_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 50) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Edited text: the last quarter of the code points (rounded down) replaced by the first as many, or
    all, of the next document by ascending id; equal ids go by a hash of the text, rows without an id come
    last. Rows whose id ``every`` divides are queries: ``n_near`` counts the other documents within RADIUS
    bits; null for the rest. Null texts are empty; texts without words have fingerprint 0; repeated rows
    stay; an empty table gives no rows; other columns are not read. Ids are whole numbers (else ValueError).
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col}: whole numbers are needed, since documents follow each other by them")
    count = SLOTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.hash("text"))
    slot, _ = slots(base.select("id"), "id", F.col("h1"))
    order = ["id", "h1", "h2"]
    # never null, so that no filter comes between the scan and the one shuffle that all branches share
    slotted = base.withColumn("slot", F.coalesce(slot, F.lit(0).cast("long")))
    rows = with_next(slotted.repartition(count, "slot"), "text", order)
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next", F.lit(1), cut)))
    rows = rows.select(*order, "slot", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    found = materialize(with_fingerprints(rows, [*order, "slot", "n_chars", "edited_sha256"], ["text", "edited"]), "fingerprints")
    prints = found.groupBy(F.col("text_fp").alias("fp")).agg(F.count(F.lit(1)).alias("n"))
    asked = found.filter(F.col("id") % every == 0).select(F.col("text_fp").alias("fp")).distinct()
    near = search(asked, prints.select("fp")).join(prints.hint("merge"), "fp").groupBy("q").agg((F.sum("n") - 1).alias("n_near"))
    near = materialize(near, "near")
    alike = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    out = with_next(found, "text_fp", order, "next_fp")
    # only queries are joined: the others would all meet under the fingerprint of the empty text and the like
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    counted = out.filter(asks).join(near.hint("merge"), F.col("text_fp") == F.col("q"), "left").drop("q")
    out = counted.unionByName(out.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", hexed("text_fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        alike("text_fp", "edited_fp").alias("near_edited"), alike("text_fp", "next_fp").alias("near_next"), "n_near",
    )
