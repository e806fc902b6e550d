"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit set where more than half of its shingle hashes have it set. Two fingerprints
that differ in at most ``2 * parts - 1`` bits, cut into ``parts`` segments, agree up to one bit in one
segment. So each segment is indexed as it is, and once with each of its bits taken out; fingerprints
meet by equality of such a variant and are then compared in full.

``near_duplicates`` links 64-bit fingerprints exactly. ``similar_groups`` is for a similarity of
shingles: the share of differing bits estimates the angle between two shingle sets, so it takes wider
fingerprints, as many segments as a target recall at that similarity needs, and decides by the
shingle sets themselves.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, new_path, scratch, setting, write
from .components import connected_components
from .words import each, text_batches

SEED = 42
WIDTH = 64
#: Fingerprints that are compared as one square table; more are compared in strips of as many.
SQUARE = 128
#: Fingerprints of one key that a task compares; a key that more share is divided.
HOT = 4096
#: Rows of numbers that go to Python together.
NUMBER_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def shingle_spans(words: list[bytes], n: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle of ``n`` words begins and ends in that."""
    import numpy as np

    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = min(n, len(words))
    return b" ".join(words), begin[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()


def fingerprint(text: str | None, n: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``n`` words, A-Z lower-cased; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, begin, end = shingle_spans(words, n)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)), dtype="<u8", count=len(begin))
    votes = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, as a signed long. Null texts count as empty."""

    def batch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = np.fromiter((fingerprint(t, n) for t in each(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batch, f"`{id_col}` {kind}, fp long")


def variants(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(key, fp): each segment of a fingerprint as it is, and without each of its bits.

    The key holds the segment's number, the bit that is taken out (none: the segment's width) and the
    rest of the segment. Few and wide segments keep the keys selective: two of 32 bits for radius 2.
    """
    parts = radius // 2 + 1
    width = WIDTH // parts
    span = width + 1
    at = F.explode(F.sequence(F.lit(0), F.lit(parts * span - 1))).alias("at")
    rows = fps.select("fp", at).withColumn("part", F.floor(F.col("at") / span).cast("int")).withColumn("bit", F.col("at") % span)
    segment = F.expr(f"shiftrightunsigned(fp, part * {width}) & {(1 << width) - 1}L")
    cut = F.when(F.col("bit") == width, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(bit as int))"))
    # a segment's rest of up to 56 bits below, the variant's number above; wider segments are hashed with it
    value = segment.bitwiseAND(F.bitwise_not(cut))
    key = F.col("at").cast("long") * F.lit(1 << width) + value if width <= 56 else F.xxhash64("at", value)
    return rows.select(key.alias("key"), "fp")


def forest(fps, radius: int):
    """Edges that join what is reachable among these distinct fingerprints by steps of ``radius`` bits or fewer.

    At most one edge for each fingerprint. Compares strips of SQUARE with all, so memory stays bounded.
    """
    import numpy as np

    fps = np.unique(np.asarray(fps, dtype=np.uint64))
    m = len(fps)
    root = np.arange(m)
    changed = True
    while changed:
        changed = False
        for at in range(0, m, SQUARE):
            strip = fps[at : at + SQUARE]
            near = np.bitwise_count(strip[:, None] ^ fps[None, :]) <= radius
            low = np.where(near, root[None, :], m).min(axis=1)
            if (low < root[at : at + SQUARE]).any():
                root[at : at + SQUARE] = np.minimum(low, root[at : at + SQUARE])
                changed = True
    move = root != np.arange(m)
    return fps[move], fps[root[move]]


def whole_keys(batches: Iterator) -> Iterator[list]:
    """The columns of batches that are sorted by the first one, cut so that no key is divided."""
    import numpy as np

    held: list = []
    together = lambda: [np.concatenate(c) for c in zip(*held, strict=True)]
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        key = columns[0]
        if held and held[-1][0][-1] != key[0]:
            yield together()
            held = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            held.append([c[:last] for c in columns])
            yield together()
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield together()


def key_groups(key, most: int | None):
    """(where groups of two begin, [(begin, end)] of larger groups, beginnings and sizes of groups above ``most``) of a sorted key column."""
    import numpy as np

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stop = np.append(start[1:], len(key))
    size = stop - start
    hot = size > most if most else np.zeros(len(size), bool)
    more = (size > 2) & ~hot
    return start[size == 2], list(zip(start[more].tolist(), stop[more].tolist(), strict=True)), start[hot], size[hot]


def other_variants(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows of hot keys under keys that hold a variant of the other segments too; no pair within the radius is lost.

    Outside the segment that the key is made of, two fingerprints differ in at most ``radius`` bits as
    well; cut into ``radius // 2 + 1`` pieces, they agree up to one bit in one piece.
    """
    parts = radius // 2 + 1
    width = WIDTH // parts
    if parts < 2:  # such a key has two fingerprints at most
        return keyed.select("key", "fp")
    piece = (WIDTH - width) // parts
    turn = F.pmod((F.floor(F.shiftrightunsigned("key", width) / (width + 1)) + 1) * width, F.lit(WIDTH)).cast("int")
    turned = F.when(turn == 0, F.col("fp")).otherwise(F.expr("shiftrightunsigned(fp, _t) | shiftleft(fp, 64 - _t)"))
    rows = keyed.withColumn("_t", turn).withColumn("_r", turned).select("key", "fp", "_r", F.explode(F.sequence(F.lit(0), F.lit(parts * (piece + 1) - 1))).alias("_at"))
    rows = rows.withColumn("_p", F.floor(F.col("_at") / (piece + 1)).cast("int")).withColumn("_b", F.col("_at") % (piece + 1))
    cut = F.when(F.col("_b") == piece, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(_b as int))"))
    value = F.expr(f"shiftrightunsigned(_r, _p * {piece}) & {(1 << piece) - 1}L").bitwiseAND(F.bitwise_not(cut))
    return rows.select(F.xxhash64("key", "_at", value).alias("key"), "fp")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all pairs within ``radius`` bits, as a written table.

    Variants are shuffled and sorted by key; a task reads its keys in order and compares the
    fingerprints of one key at a time. It emits a forest for each key and never all pairs. Of a key that
    more than HOT fingerprints share it only says so; their rows are dealt out again by ``other_variants``.
    """
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(most: int | None):
        def edges(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for key, fp in whole_keys(batches):
                fp = fp.view(np.uint64)
                two, more, hot, size = key_groups(key, most)
                near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
                us, vs = [fp[two[near]]], [fp[two[near] + 1]]
                for a, z in more:
                    u, v = forest(fp[a:z], radius)
                    us.append(u), vs.append(v)
                pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0).view(np.int64)
                found = np.concatenate([pairs, np.stack([key[hot], size], axis=1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(2)] + [pa.array(np.arange(len(found)) >= len(pairs))], names=["u", "v", "hot"])

        return edges

    def compared(keyed: DataFrame, most: int | None) -> DataFrame:
        with setting(spark, *NUMBER_ROWS):
            return materialize(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(scan(most), "u long, v long, hot boolean"), "links")

    keyed = variants(fps.select("fp").distinct(), radius)
    found = compared(keyed, HOT)
    hot = found.filter("hot").select(F.col("u").alias("key"))
    if not hot.isEmpty():
        found = found.filter("not hot").unionByName(compared(other_variants(keyed.join(hot, "key", "left_semi"), radius), None))
    return found.select("u", "v")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id reachable over links, its own included).

    Links join fingerprints at ``radius`` or fewer differing bits. Null and empty texts have
    fingerprint 0 and link like any other. Repeated rows and equal texts share a fingerprint; they are
    one node, so no pairs of copies arise. A null id takes part, but never names a component unless
    all ids of the component are null. An empty table gives no rows. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    base = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, n=n), "fingerprints")
    nodes = base.groupBy("fp").agg(F.min(id_col).alias("low"))
    found = connected_components(links(nodes, radius))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select(nodes["fp"], "low", F.coalesce("root", nodes["fp"]).alias("root"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = roots.join(lowest, "root").select("fp", "component_id")
    return base.join(classes, "fp").select(id_col, "fp", "component_id")


#: Similarity of shingle sets from which documents are near-duplicates, and share of pairs at just that similarity to be found.
SIMILAR, RECALL = 0.8, 0.95
#: 64-bit words of a wide fingerprint at least; bits of a segment at least and at most; variants of a fingerprint that are dealt out together.
LEAST_WORDS, LEAST_BITS, MOST_BITS, TOGETHER = 3, 12, 32, 40
#: Mark of edges that only say that two nodes belong to one cluster of candidates.
STAR = -2
#: Texts of a strip of a cluster, about, and bytes of their shingle sets; two strips are compared at a time.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Shared shingles that are counted at once.
COUNTED = 1 << 22
#: Fingerprints that share a key by chance, about: comparing these in place costs less than the rows that narrower keys take.
SHARE = 64


def differing(similarity: float) -> float:
    """Share of bits that differ between the fingerprints of two sets of this Jaccard similarity and one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segments_for(count: int, similarity: float = SIMILAR, recall: float = RECALL) -> tuple[int, int, int, int]:
    """(segments, bits of a segment, 64-bit words of a fingerprint, radius) for this many fingerprints.

    A segment without one bit tells as many keys apart as leave about SHARE fingerprints to each by
    chance. Two at the similarity agree in it up to one bit with a chance that its width gives; there
    are as many segments as the recall needs. The radius, three standard deviations beyond the expected
    distance, only passes over what cannot be alike: the shingles decide.
    """
    q = differing(similarity)
    width = min(max(math.ceil(math.log2((count + 1) / SHARE)) + 1, LEAST_BITS), MOST_BITS)
    one = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
    parts = math.ceil(math.log(1 - recall) / math.log(1 - one))
    words = max(LEAST_WORDS, -(-parts * width // WIDTH))
    bits = words * WIDTH
    return parts, width, words, math.ceil(q * bits + 3 * math.sqrt(q * (1 - q) * bits))


def shingle_set(text: str | None, n: int = 5, seed: int = SEED):
    """Sorted XXH64 hashes of the distinct shingles of ``n`` words, A-Z lower-cased."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, begin, end = shingle_spans(words, n)
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)), dtype="<u8", count=len(begin)))


def wide_fingerprint(hashes, words: int):
    """``words`` 64-bit words of SimHash bits of a shingle set."""
    import numpy as np

    votes = np.zeros((words, WIDTH), dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        for k in range(words):
            mixed = (part ^ (part >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E018 * k) % (1 << 64))
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            votes[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(votes.ravel() * 2 > len(hashes), bitorder="little").view("<u8")


def alike(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed shingle sets (sorted 32-bit halves of the hashes); two empty ones are alike."""
    import numpy as np

    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def distances(fp) -> Iterator[tuple]:
    """(first row, differing bits of rows from there to all up to the last of them; 1 << 15 to itself and those after it), SQUARE rows at a time."""
    import numpy as np

    m = len(fp)
    for at in range(0, m, SQUARE):
        end = min(at + SQUARE, m)
        far = np.zeros((end - at, end), np.uint16)
        for k in range(fp.shape[1]):
            far += np.bitwise_count(fp[at:end, k, None] ^ fp[None, :end, k])
        far[np.arange(end)[None] >= np.arange(at, end)[:, None]] = 1 << 15
        yield at, far


def nearest_before(fp, radius: int):
    """(i, j, low): rows and the nearest row before each that is within ``radius`` bits, the first of several; of every row the first that is reachable by such steps."""
    import numpy as np

    ones, twos, low = [], [], np.arange(len(fp))
    for at, far in distances(fp):
        to = far.argmin(axis=1)
        row = np.arange(len(far))
        near = far[row, to] <= radius
        ones.append(row[near] + at), twos.append(to[near])
        end = far.shape[1]
        own = np.where(near, to, row + at)
        low[at:end] = own
        while (low[own] != low[at:end]).any():  # along the nearest rows, which stand before
            low[at:end] = low[own]
            own = low[at:end].copy()
        i, j = np.nonzero((far <= radius) & (low[at:end, None] != low[None, :end]))
        for x, y in zip((i + at).tolist(), j.tolist(), strict=True):
            x, y = low[x], low[y]
            if x != y:
                low[low == max(x, y)] = min(x, y)
    return np.concatenate(ones), np.concatenate(twos), low


def candidate_edges(nodes: DataFrame, names: list[str], parts: int, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(u, v): the nearest node u within ``radius`` bits that stands before v under a variant of a segment; and (u, v): clusters.

    Any two nodes that share a variant and are within the radius are connected over the second table,
    which has an edge from every node of a key to the first one reachable in it, and never all pairs.

    ``nodes``: node, the words of its fingerprint. Segments are dealt out a few at a time, so that the
    disk holds TOGETHER variants of a fingerprint at once. Keys that more than HOT nodes share are cut into
    strips, and each pair of strips is a task's.
    """
    spark = nodes.sparkSession
    words = len(names)
    fields = ", ".join(f"{x} long" for x in names)

    def spread(some: list[int]):
        def rows(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            power = np.int64(1) << np.arange(width)
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    fp = np.stack([part.column(k + 1).to_numpy(zero_copy_only=False) for k in range(words)], axis=1)
                    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
                    for s in some:
                        value = bits[:, s * width : (s + 1) * width].astype(np.int64) @ power
                        key = (value[:, None] & ~power) + ((s * width + np.arange(width)) << width)
                        again = pa.array(np.repeat(np.arange(len(fp)), width))
                        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(c.take(again) for c in part.columns)], names=["key", "node", *names])

        return rows

    def scan(most: int | None):
        def edges(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            def batch(u, v, far):
                found = np.unique(np.stack([u, v, far], axis=1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(2)] + [pa.array(found[:, 2].astype(np.int32))], names=["u", "v", "far"])

            for columns in whole_keys(batches):
                key, node = columns[0], columns[1]
                fp = np.stack(columns[2 : 2 + words], axis=1).view(np.uint64)
                far = lambda u, v: np.bitwise_count(fp[u] ^ fp[v]).sum(axis=1).astype(np.int64)  # noqa: E731, B023
                two, more, hot, size = key_groups(key, most)
                near = far(two, two + 1) <= radius
                us, vs = [two[near]], [two[near] + 1]
                firsts, others = [two[near]], [two[near] + 1]
                for a, z in more:
                    v, u, low = nearest_before(fp[a:z], radius)
                    us.append(u + a), vs.append(v + a)
                    moved = np.flatnonzero(low != np.arange(z - a))
                    firsts.append(low[moved] + a), others.append(moved + a)
                u, v = np.concatenate(us), np.concatenate(vs)
                yield batch(node[u], node[v], far(u, v))
                u, v = np.concatenate(firsts), np.concatenate(others)
                yield batch(node[u], node[v], np.full(len(u), STAR))
                yield batch(key[hot], size, np.full(len(hot), -1))  # of a hot key only the number

        return edges

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(keyed: DataFrame, most: int | None) -> DataFrame:
        with setting(spark, *NUMBER_ROWS):
            return materialize(keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(scan(most), "u long, v long, far int"), "edges")

    step = max(1, TOGETHER // width)
    parts_done = []
    for at in range(0, parts, step):
        keyed = nodes.repartition(n).mapInArrow(spread(list(range(at, min(parts, at + step)))), f"key long, node long, {fields}")
        found = compared(keyed, HOT)
        hot = found.filter("far = -1").select(F.col("u").alias("key"), F.col("v").alias("_n"))
        parts_done.append(found.filter("far <> -1"))
        if not hot.isEmpty():
            strips = F.ceil(F.col("_n") / HOT)
            own = F.pmod(F.xxhash64("node"), strips)
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), strips - 1), lambda x: F.xxhash64(F.col("key"), F.least(x, own), F.greatest(x, own)))
            parts_done.append(compared(keyed.join(hot, "key").select(F.explode(pairs).alias("key"), "node", *names), None))
    found = functools.reduce(DataFrame.unionByName, parts_done)
    nearest = found.filter(F.col("far") != STAR).groupBy("v").agg(F.min(F.struct("far", "u")).alias("b"))
    return nearest.select(F.col("b.u").alias("u"), "v"), found.filter(F.col("far") == STAR).select("u", "v")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (x, y, u, v) whose nodes u and v have shingle sets that are ``similarity`` alike or more, as (x, y); ``sets``: node, shingles."""

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep = [alike(x, y) >= similarity for x, y in zip(each(b.column(2)), each(b.column(3)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = edges.select("x", "y", "u", "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("x", "y", "a", "b").mapInArrow(decide, "x long, y long")


def joining(left, right, sets: list, kinds, similarity: float) -> list[tuple[int, int]]:
    """Pairs of kinds that join what alike rows of ``left`` and ``right`` connect; fewer pairs than there are kinds.

    ``sets``: sorted numbers of each row. Counts for each row of ``left`` what it shares with all of
    ``right`` at once, over the rows that hold each of its numbers.
    """
    import numpy as np

    size = np.fromiter(map(len, sets), np.int64, len(sets))
    held = np.concatenate([sets[j] for j in right])
    order = np.argsort(held, kind="stable")
    owner, held = np.repeat(right, size[right])[order], held[order]
    known, root = np.unique(kinds, return_inverse=True)
    known, of, found = known.tolist(), np.arange(len(known)), []
    for i in left:
        begin, count = np.searchsorted(held, sets[i]), np.searchsorted(held, sets[i], "right")
        count -= begin
        # not alike to any row if too few of its numbers are in other rows
        if not size[i] or (count > (i in right)).sum() / size[i] < similarity:
            continue
        both, total = np.zeros(len(sets), np.int64), np.cumsum(count)
        cuts = [0, *np.unique(np.searchsorted(total, np.arange(COUNTED, total[-1], COUNTED))).tolist(), len(count)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            b, c = begin[a:z], count[a:z]
            where = np.repeat(b - np.cumsum(c) + c, c) + np.arange(c.sum())
            both += np.bincount(owner[where], minlength=len(sets))
        near = np.flatnonzero(both / (size[i] + size - both) >= similarity)
        for k in np.unique(root[near]).tolist():
            x, y = of[k], of[root[i]]
            if x != y:
                found.append((known[x], known[y]))
                of[of == max(x, y)] = min(x, y)
    return found


def joined_blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(x, y): edges that join the classes of a cluster wherever texts of them are ``similarity`` alike or more.

    ``rows``: node, cluster, x (its class). Shingle sets go to their cluster and are compared there, so no
    row is made for a pair. Clusters of more than BLOCK texts, or BLOCK_BYTES, are cut into strips, and each pair of strips is
    a group; a text has a copy for each strip.
    """

    def decide(table):
        import numpy as np
        import pyarrow as pa

        own, kinds = (table.column(k).to_numpy() for k in ("own", "x"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        hashes = [np.frombuffer(x, "<u4") for x in each(table.column("shingles"))]
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        pairs = joining(left, right, hashes, kinds, similarity) if len(left) and len(right) else []
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["x", "y"])

    sized = rows.join(sets.select("node", "size"), "node")
    strips = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("strips")
    # two texts were decided as each other's nearest, and one class has nothing left to join
    many = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), strips)
    asked = rows.join(many.filter("n > 2 and low < high").select("cluster", "strips"), "cluster").withColumn("own", F.pmod(F.xxhash64("node"), "strips"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))
    dealt = asked.withColumn("o", other).select("node", "cluster", "x", "own", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"))
    return dealt.join(sets.select("node", "shingles"), "node").groupBy("cluster", "a", "b").applyInArrow(decide, "x long, y long")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(id, digest, group): documents joined by pairs whose shingle sets of ``n`` words are ``similarity`` alike or more.

    Candidates come from equal one-wildcard variants of segments of wide fingerprints: by plan, a pair at
    just that similarity is met with the chance ``recall``, a closer one more surely. The shingle sets
    decide: first each node's nearest candidate; then, within clusters of all that candidates connect,
    every pair that is still apart, so no candidate is left out that could change a group.

    ``digest``: MD5 of the text; ``group``: a number. Equal fingerprints are one node. Texts without words
    are alike. Ids may be null or repeated and of any type; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    parts, width, words, radius = segments_for(docs.count(), similarity, recall)
    names = [f"f{k}" for k in range(words)]

    def digest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps, sets = np.empty((b.num_rows, words), np.uint64), []
            for i, t in enumerate(each(b.column(2))):
                hashes = shingle_set(t, n)
                fps[i] = wide_fingerprint(hashes, words)
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(words)), pa.array(sets, pa.binary())], names=["id", "digest", *names, "shingles"])

    fields = ", ".join(f"{x} long" for x in names)
    rows = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    base = materialize(rows.mapInArrow(digest, f"id {kind}, digest string, {fields}, shingles binary"), "fingerprints")
    nodes = materialize(base.select(*names).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    nearest, stars = candidate_edges(nodes.select("node", *names), names, parts, width, radius)
    clusters = materialize(connected_components(stars), "clusters")
    asked = clusters.select("node").join(nodes, "node")
    sets = base.select(*names, "shingles").join(asked, names).dropDuplicates(["node"]).select("node", F.length("shingles").alias("size"), "shingles")
    sets = materialize(sets, "shingles")
    roots = connected_components(verified(nearest.select(F.col("u").alias("x"), F.col("v").alias("y"), "u", "v"), sets, similarity))
    classes = materialize(nodes.join(roots.select("node", F.col("root").alias("x")), "node", "left").withColumn("x", F.coalesce("x", "node")), "classes")
    rows = clusters.select("node", F.col("root").alias("cluster")).join(classes.select("node", "x"), "node")
    joined = connected_components(joined_blocks(rows, sets, similarity)).select(F.col("node").alias("x"), F.col("root").alias("_r"))
    classes = classes.join(joined, "x", "left").withColumn("x", F.coalesce("_r", "x"))
    classes = classes.select(*names, F.col("x").alias("group"))
    return base.drop("shingles").join(classes, names).select(F.col("id").alias(id_col), "digest", "group")


def text_digest(text: Column) -> Column:
    """MD5 of a text; a null text counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near-duplicates, with all their columns.

    First is the smallest id; null ids come last, and of equal ids the text with the smallest digest. Of
    wholly equal rows one stays. Other arguments are those of ``similar_groups``.
    """
    spark = docs.sparkSession
    path = new_path(spark, "groups")
    with scratch(spark):  # fingerprints, shingles and edges go before the documents are written again
        found = similar_groups(docs, id_col=id_col, text_col=text_col, **kwargs).toDF("id", "digest", "group")
        write(found, path)
    groups = spark.read.schema(found.schema).parquet(path)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    kept = groups.groupBy("group").agg(F.min(rank).alias("b")).select(F.col("b.id").alias("_kept"), F.col("b.digest").alias("_kept_digest"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*names).withColumn("_digest", text_digest(F.col(text)))
    # every kept pair of id and digest is one group's, so the join repeats no row
    found = rows.join(kept, (rows["_digest"] == kept["_kept_digest"]) & rows[key].eqNullSafe(kept["_kept"]), "left_semi")
    order = [F.col(c) for c, kind in found.dtypes if not kind.startswith("map")]
    once = found.withColumn("_k", F.row_number().over(Window.partitionBy("_digest", key).orderBy(*order))).filter(F.col("_k") == 1)
    return once.select(*names).toDF(*docs.columns)


def as_hex(fp: str) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
