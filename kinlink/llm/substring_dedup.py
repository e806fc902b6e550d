"""Substring dedup over a log-structured index of window fingerprints.

Documents come in batches of ascending id. Each batch's window fingerprints are merge-joined with the
sorted, immutable runs that earlier batches left, matches are verified with a second fingerprint that
comes from other word hashes, and the batch's new fingerprints become a run of their own; when runs
pile up they are compacted into one. A match needs 96 equal bits of two independent families: among
10**13 windows, less than one false match in a hundred corpora is to be expected.

Python tasks exchange blocks, one for each pair of task and bucket, so that Spark moves a few large
rows instead of one row for each window. A task sends each fingerprint once for each block it reads:
what repeats inside the block is settled there, so that a passage that half the documents share does
not meet in one task.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..memo import memo
from .words import each, text_batches

WINDOW = 13
#: Bytes of text for each bucket of fingerprints and each group of documents, in a block of a task, and hashed at a time.
BUCKET_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
STRIP_BYTES = 1 << 20
#: Runs of the index beyond which they are compacted.
FANOUT = 4
#: How many times the documents before it a batch holds, about; early runs stay small, since each later batch reads them.
GROWTH = 4
#: Turns in which a batch's buckets are dealt out: the disk holds the windows of one turn at a time, for hashing the text in each.
TURNS = 2
LAST = (1 << 63) - 1
BLOCKS = "kind int, b int, blob binary"
BATCH, RUN, HITS, DOCS = 0, 1, 2, 3
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a word whose values are looked up; those further on are computed.
NEAR = 64


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _values(byte, offset, family: int):
    """A pseudo-random number for each byte at each place of a word; no relation between places, unlike powers of a base."""
    import numpy as np

    place = _mix(offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51AFD7ED + 0x632BE59BD9B4E019 * family))
    return _mix(place + (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


@memo
def _tables():
    """White space by byte; for both families the values of the first NEAR places; odd multipliers of the windows."""
    import numpy as np

    space = np.zeros(256, dtype=bool)
    space[list(SPACE)] = True
    byte, offset = np.tile(np.arange(256), NEAR), np.repeat(np.arange(NEAR), 256)
    odd = np.random.Generator(np.random.PCG64(20240613)).integers(0, 1 << 63, size=2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return space, [_values(byte, offset, k) for k in (0, 1)], odd


def word_hashes(data: bytes):
    """(two independent hashes of each word, as two arrays, byte at which each word begins)."""
    import numpy as np

    space, near, _ = _tables()
    hashes, begins, at = ([], []), [], 0
    while at < len(data):
        stop = min(len(data), at + STRIP_BYTES)
        while stop < len(data) and data[stop] not in SPACE:  # a word is never cut
            stop += 1
        part = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
        inside = ~space[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = np.flatnonzero(first)
        if len(begin):
            where = np.flatnonzero(inside)
            start = np.searchsorted(where, begin)
            offset = where - np.repeat(begin, np.diff(np.append(start, len(where))))
            byte = part[where]
            far = np.flatnonzero(offset >= NEAR)
            key = np.minimum(offset, NEAR - 1) * 256 + byte
            for k in (0, 1):
                value = near[k][key]
                if len(far):
                    value[far] = _values(byte[far], offset[far], k)
                hashes[k].append(_mix(np.add.reduceat(value, start)))
            begins.append(begin + at)
        at = stop
    if not begins:
        none = np.zeros(0, np.uint64)
        return (none, none), np.zeros(0, np.int64)
    return (np.concatenate(hashes[0]), np.concatenate(hashes[1])), np.concatenate(begins)


def window_hashes(words, width: int):
    """(64-bit fingerprint, independent 32-bit check) of each window of ``width`` words."""
    import numpy as np

    _, _, odd = _tables()
    out = []
    for k in (0, 1):
        n = max(0, len(words[k]) - width + 1)
        total = np.zeros(n, np.uint64)
        for i in range(width if n else 0):
            total *= odd[k]
            total += words[k][i : i + n]
        out.append(_mix(total))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


#: Types of the arrays in a block, by their number there.
KINDS = ("<u8", "<i8", "<u4", "<i4", "<i2", "|u1")
#: Bytes from which a block is compressed.
LONG = 1 << 10


def _pack(*arrays) -> bytes:
    """Arrays one after another, each behind its type and length; long blocks compressed."""
    import numpy as np
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<BI", KINDS.index(a.dtype.str), a.size), a.tobytes()]
    whole = b"".join(parts)
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(whole) if len(whole) >= LONG else b"\0" + whole


def _unpack(blob: bytes) -> list:
    import numpy as np
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[:1] == b"\1" else blob[1:]
    out, at = [], 0
    while at < len(whole):
        kind, n = struct.unpack_from("<BI", whole, at)
        out.append(np.frombuffer(whole, KINDS[kind], n, at + 5))
        at += 5 + out[-1].nbytes
    return out


def _pack_run(one, two) -> bytes:
    """A sorted run: gaps between fingerprints, byte plane by byte plane, which compress well."""
    import numpy as np

    gap = np.diff(one, prepend=np.uint64(0))
    return _pack(gap.view(np.uint8).reshape(-1, 8).T.ravel(), two)


def _unpack_run(blob: bytes):
    import numpy as np

    gap, two = _unpack(blob)
    return np.cumsum(np.ascontiguousarray(gap.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64), two


def _hit_blocks(docs, pos, two, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Matched windows as blocks for the groups of documents that they belong to."""
    import numpy as np

    group = _group_of(docs, groups)
    order = np.lexsort((pos, docs, group))
    docs, pos, two, group = docs[order], pos[order], two[order], group[order]
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
        gap = np.diff(pos[a:z], prepend=0).astype(np.int32)
        yield HITS, int(group[a]), _pack(np.diff(docs[a:z], prepend=0), gap, two[a:z])


def _group_of(docs, groups: int):
    import numpy as np

    return (_mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _frames(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    kinds, buckets, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "b", "blob"])


def _block_windows(ids, texts: list[bytes], width: int, buckets: int, groups: int, turn: int) -> list[tuple[int, int, bytes]]:
    """Blocks of one set of documents, for the buckets whose turn it is: what is settled here as hits, the rest by bucket."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order.tolist()]
    words, begin = word_hashes(b"\n".join(texts))
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.cumsum(length + 1) - length - 1
    first_word = np.searchsorted(begin, edge)
    n_words = np.diff(np.append(first_word, len(begin)))
    one, two = window_hashes(words, width)
    n_win = np.maximum(n_words - width + 1, 0)
    row = np.repeat(np.arange(len(ids)), n_win)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    at = first_word[row] + pos
    one, two = one[at], two[at]
    mine = (one % np.uint64(buckets)) % np.uint64(TURNS) == turn
    row, pos, one, two = row[mine], pos[mine], one[mine], two[mine]
    order = np.argsort(one, kind="stable")
    s, t = one[order], two[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    lead = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(s) else order
    late = ids[row[order]] > ids[row[lead]]
    rows = []
    if late.any():
        x = order[late]
        rows += _hit_blocks(ids[row[x]], pos[x], two[x], groups)
    # other rows of the same id hold the window at a place of their own
    again = ~fresh & ~late & (pos[order] != pos[lead])
    again[1:] &= row[order][1:] != row[order][:-1]
    keep = np.sort(order[fresh | again])
    if not len(keep):
        return rows
    bucket = (one[keep] % np.uint64(buckets)).astype(np.int64)
    keep = keep[np.argsort(bucket, kind="stable")]
    bucket = (one[keep] % np.uint64(buckets)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        x = keep[a:z]
        of, back = np.unique(row[x], return_inverse=True)
        rows.append((BATCH, int(bucket[a]), _pack(ids[of], np.diff(back, prepend=0).astype(np.int16 if len(of) < 1 << 15 else np.int64), np.diff(pos[x], prepend=0).astype(np.int32), two[x], one[x])))
    return rows


def _map_windows(width: int, buckets: int, groups: int, turn: int):
    def scan(batches: Iterator) -> Iterator:
        import numpy as np

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(each(b.column(0)), each(b.column(1)), strict=True):
                if not t:
                    continue
                ids.append(i), texts.append(t.encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield _frames(_block_windows(np.array(ids, np.int64), texts, width, buckets, groups, turn))
                    ids, texts, held = [], [], 0
        if ids:
            yield _frames(_block_windows(np.array(ids, np.int64), texts, width, buckets, groups, turn))

    return scan


def _match_bucket(groups: int, keep: bool):
    """Merge-joins the blocks of one bucket with its runs; returns hits and the new run."""

    def match(table):
        import numpy as np

        ones, twos, docs, poss, old, old_check = [], [], [], [], [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if kind == RUN:
                one, two = _unpack_run(blob)
                old.append(one), old_check.append(two)
            else:
                ids, row, gap, two, one = _unpack(blob)
                ones.append(one), twos.append(two)
                docs.append(ids[np.cumsum(row, dtype=np.int64)])
                poss.append(np.cumsum(gap, dtype=np.int64))
        bucket, rows = table["b"][0].as_py(), []
        if ones:
            one, two, doc, pos = map(np.concatenate, (ones, twos, docs, poss))
            order = np.lexsort((doc, two, one))
            one, two, doc, pos = one[order], two[order], doc[order], pos[order]
            fresh = np.ones(len(one), bool)
            fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            seen = np.zeros(len(one), bool)
            for run, check in zip(old, old_check, strict=True):  # both sides are sorted
                at = np.searchsorted(run, one)
                while True:
                    ok = at < len(run)
                    ok[ok] = run[at[ok]] == one[ok]
                    if not ok.any():
                        break
                    seen[ok] |= check[at[ok]] == two[ok]
                    at[ok] += 1
                    at[~ok] = len(run)
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = seen | (doc > doc[lead])
            if hit.any():
                rows += _hit_blocks(doc[hit], pos[hit], two[hit], groups)
            new = fresh & ~seen
            if keep and new.any():
                rows.append((RUN, bucket, _pack_run(one[new], two[new])))
        import pyarrow as pa

        return pa.Table.from_batches([_frames(rows)])

    return match


def _merge_runs(table):
    import numpy as np
    import pyarrow as pa

    runs = [_unpack_run(b) for b in table["blob"].to_pylist()]
    one, two = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return pa.Table.from_batches([_frames([(RUN, table["b"][0].as_py(), _pack_run(one[fresh], two[fresh]))])])


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a folder; ``buckets`` is fixed for its life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.runs: list[list[str]] = []  # folders of each run
        self._made = 0

    def read(self) -> DataFrame | None:
        if not self.runs:
            return None
        runs = [self.spark.read.schema(BLOCKS).parquet(x).filter(F.col("kind") == RUN) for run in self.runs for x in run]
        return functools.reduce(DataFrame.unionByName, runs)

    def new_run(self) -> str:
        self._made += 1
        return f"{self.path}/run-{self._made:06d}"

    def drop(self) -> None:
        """Deletes all runs; what else was written beside them stays."""
        for run in self.runs:
            for x in run:
                storage.remove(self.spark, f"{x}/kind={RUN}")
        self.runs = []

    def add(self, run: list[str]) -> None:
        """Adds a written run; more than ``fanout`` runs are compacted into one, some buckets at a time."""
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            made = []
            for turn in range(TURNS):
                made.append(self.new_run())
                part = self.read().filter(F.col("b") % TURNS == turn)
                storage.write(part.groupBy("b").applyInArrow(_merge_runs, BLOCKS), made[-1], by="kind")
            self.drop()
            self.runs = [made]


def match_batch(docs: DataFrame, index: FingerprintIndex, *, groups: int, width: int = WINDOW, keep: bool = True) -> DataFrame:
    """Windows of a batch (columns id, text) that history or a smaller id of the batch has, as blocks.

    History counts as smaller than all of the batch. With ``keep`` the batch's new fingerprints become
    a run of the index.
    """
    spark = docs.sparkSession
    settled = F.when(F.col("kind") == HITS, -1 - F.pmod(F.xxhash64("blob"), F.lit(index.buckets))).otherwise(F.col("b")).cast("int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    match = _match_bucket(groups, keep)

    def either(table):  # what a task settled alone only passes through
        return table.select(["kind", "b", "blob"]) if table["kind"][0].as_py() == HITS else match(table)

    old, made = index.read(), []
    for turn in range(TURNS):
        step = docs.mapInArrow(_map_windows(width, index.buckets, groups, turn), BLOCKS)
        if old is not None:
            step = step.unionByName(old.filter(F.col("b") % TURNS == turn))
        found = step.withColumn("g", settled).repartition(max(n, min(index.buckets, 4 * n)), "g").groupBy("g").applyInArrow(either, BLOCKS)
        made.append(storage.new_path(spark, "matched"))
        storage.write(found, made[-1], by="kind")
    hits = functools.reduce(DataFrame.unionByName, [spark.read.schema(BLOCKS).parquet(x).filter(F.col("kind") == HITS) for x in made])
    if keep:
        index.add(made)
    return hits


def _map_docs(id_at: int, groups: int):
    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        for b in batches:
            if not b.num_rows:
                continue
            group = _group_of(np.array([LAST if i is None else i for i in b.column(id_at).to_pylist()], np.int64), groups)
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1))
            rows = []
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                part = pa.Table.from_batches([b]).take(pa.array(order[a:z]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                rows.append((DOCS, int(group[order[a]]), zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())))
            yield _frames(rows)

    return scan


def covered(words, hits, checks, width: int):
    """Which words lie in a window whose fingerprint is among those at positions ``hits``."""
    import numpy as np

    one, two = window_hashes(words, width)
    n = len(words[0])
    ok = hits < len(one)
    hits, checks = hits[ok], checks[ok]
    hits = hits[two[hits] == checks]  # of another text with the same id
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(one, one[hits]))
    cover[at] += 1
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover[:-1]) > 0


def without(text: bytes, gone) -> bytes:
    """The text without the marked words and the white space before them."""
    parts = re.findall(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)
    return b"".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g).lstrip(SPACE)


def _finish(id_at: int, text_at: int, width: int, report: bool):
    def finish(table):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        found, parts = {}, []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if kind == HITS:
                docs, pos, two = _unpack(blob)
                docs, pos = np.cumsum(docs), np.cumsum(pos, dtype=np.int64)
                cut = np.flatnonzero(np.diff(docs, prepend=-1 if not len(docs) else docs[0] - 1))
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(docs)], strict=True):
                    found.setdefault(int(docs[a]), []).append((pos[a:z], two[a:z]))
            else:
                parts.append(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all())
        if not parts:
            raise ValueError("matched windows of documents that are not there")
        rows = pa.concat_tables(parts)
        n_words, n_removed, digest, kept = [], [], [], []
        for i, t in zip(rows.column(id_at).to_pylist(), rows.column(text_at).to_pylist(), strict=True):
            data = t.encode("utf-8", "surrogatepass") if t else b""
            words = data.split()
            hits, gone = found.get(LAST if i is None else i), None
            if hits:
                pos, check = (np.concatenate(x) for x in zip(*hits, strict=True))
                gone = covered(word_hashes(data)[0], pos, check, width)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()) if gone is not None else 0)
            if report:
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            else:
                kept.append(without(data, gone).decode("utf-8", "surrogatepass") if n_removed[-1] else t)
        if report:
            return pa.table([rows.column(id_at), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])
        some = pa.array([not r or r < n for n, r in zip(n_words, n_removed, strict=True)], pa.bool_())
        return rows.set_column(text_at, rows.field(text_at), pa.array(kept, rows.field(text_at).type)).filter(some)

    return finish


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
    batches: int = 3,
    fanout: int = 1,
    index: FingerprintIndex | None = None,
    report: bool = False,
) -> DataFrame:
    """Removes each word covered by a window of ``width`` words that also starts in a document of smaller id.

    ``batches`` of ascending id, each GROWTH times those before it, pass through an index that holds ``fanout`` runs
    before it compacts them.
    Windows are judged on the input. Without ``report``: the rows of ``docs`` with the words taken out
    of the text (with the white space before them), less those that lose all words. With ``report``:
    ``id_col``, n_words, n_removed, kept_sha256 (kept words joined by one space) for every row.

    Ids of other types than whole numbers are refused (ValueError). With ``index``, all documents are matched with its history as well, and their fingerprints added.
    Null and empty texts have no words and stay as they are. Rows of equal id never remove words from
    each other; a null id counts as the largest. Extra columns are carried along whatever their names.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    if docs.schema[id_at].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col}: whole numbers are needed, since the smallest id keeps a passage")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.percentile_approx(key, [float(GROWTH) ** (i - batches) for i in range(1, batches)] or [0.5], 10_000)).first()
    groups = max(8, -(-size[0] // BUCKET_BYTES))
    own = index is None
    if own:
        index = FingerprintIndex(spark, storage.new_path(spark, "fingerprints"), groups, fanout)
    edges = sorted(set(size[1] or []))[: batches - 1] if batches > 1 else []
    source = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    hits = None
    for k in range(len(edges) + 1):
        part = source
        if k:
            part = part.filter(F.col("id") > edges[k - 1])
        if k < len(edges):
            part = part.filter(F.col("id") <= edges[k])
        found = match_batch(part, index, groups=groups, width=width, keep=not own or k < len(edges))
        hits = found if hits is None else hits.unionByName(found)
    if own:
        index.drop()
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names).select(names[id_at], names[text_at]) if report else docs.toDF(*names)
    at = (0, 1) if report else (id_at, text_at)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" if report else whole.schema
    both = whole.mapInArrow(_map_docs(at[0], groups), BLOCKS).unionByName(hits)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = both.repartition(max(n, min(groups, 4 * n)), "b").groupBy("b").applyInArrow(_finish(*at, width, report), schema)
    return done.withColumnRenamed("id", id_col) if report else done.toDF(*docs.columns)
