"""Benchmark decontamination by CGK embeddings and bit sampling.

The CGK random walk writes a sequence of words as a longer one so that few edits become few differing
places. Walks over item-sized windows of a document and over the benchmark items are sampled at a few
places; windows whose samples equal an item's in any repetition are candidates, and an exact edit
distance decides. How many repetitions an item's length needs follows from a target recall at the
largest number of edits that it allows. Before that, windows that cannot be within the allowed edits are passed over: with
at most k edits, one of k + 1 pieces of the item stands unchanged in the window, so only windows
around a shared run of GRAM words are walked (no loss while every item has n >= GRAM * (k + 1)).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..memo import memo
from ..storage import materialize
from .words import each, text_batches

#: Share of an item's words that may be edited.
EDITS = 0.2
GRAM = 4
#: Share of passages at the largest number of allowed edits that the walks of an item must find, and places sampled from a walk.
RECALL, PLACES = 0.985, 3
#: Edited copies by which the repetitions for an item length are chosen, and repetitions tried together.
TRIALS, STEP = 256, 8
#: Characters of benchmark that one pass holds in each task; a larger benchmark takes more passes.
PASS_CHARS = 4 << 20


def normal_words(text: str | None) -> list[str]:
    """Words in lower case, without what is no letter or digit at their ends; words with neither go."""
    out = []
    for w in (text or "").lower().split():
        if not (w[0].isalnum() and w[-1].isalnum()):
            a, z = 0, len(w)
            while a < z and not w[a].isalnum():
                a += 1
            while z > a and not w[z - 1].isalnum():
                z -= 1
            w = w[a:z]
        if w:
            out.append(w)
    return out


class Numbers(dict):
    """Word number of each raw lower-case word: that of its normal form, -1 if no item has it, -3 if nothing is left."""

    MOST = 1 << 20  #: words that are remembered; then it starts afresh

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __missing__(self, raw: str) -> int:
        words = normal_words(raw)
        if len(self) >= self.MOST:
            self.clear()
        self[raw] = out = self.known.get(words[0], -1) if words else -3
        return out

    def __reduce__(self):
        return Numbers, (self.known,)

    def of(self, text: str | None):
        import numpy as np

        words = (text or "").lower().split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids[ids != -3]


def allowed(n: int) -> int:
    """Edits allowed for an item of n words; short items must keep GRAM words in a row."""
    return min(int(EDITS * n), max(0, n // GRAM - 1))


def walk(ids, n: int, seeds):
    """CGK walks: (rows, n) words written, -1 past the end, for (rows, n) word numbers and a seed for each row.

    At step j the word under the pointer is written, and the pointer moves on if the bit that step j
    gives to this word is set. A whole walk takes up to 3n steps; only the first n are sampled.
    """
    import numpy as np

    row = np.arange(len(ids))
    at = np.zeros(len(ids), np.int64)
    salt = seeds.astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63)
    steps = max(PLACES, n)
    out = np.full((len(ids), steps), -1, np.int64)
    for j in range(steps):
        live = at < n
        word = ids[row, np.minimum(at, n - 1)]
        out[:, j] = np.where(live, word, -1)
        mixed = (word.astype(np.uint64) + salt + np.uint64(j * 0x9E3779B1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        at += live & ((mixed >> np.uint64(63)) == 1)
    return out


def places(n: int, seed: int):
    """PLACES steps of a walk over n words, in the first half: later ones have met more edits."""
    import numpy as np

    return np.sort(np.random.default_rng(1000 + seed).choice(max(PLACES, n), PLACES, replace=False))


def sampled(ids, n: int, first: int, last: int):
    """(rows, repetitions, PLACES) words that the walks of repetitions ``first`` to ``last`` write at their places."""
    import numpy as np

    count = last - first
    seeds = np.tile(np.arange(first, last), len(ids))
    written = walk(np.repeat(ids, count, axis=0), n, seeds).reshape(len(ids), count, -1)
    return np.stack([written[:, r, places(n, first + r)] for r in range(count)], axis=1)


@memo
def repeats(n: int) -> int:
    """Repetitions by which RECALL of the windows at the largest number of edits meet their item in one of them.

    Measured on TRIALS copies of n different words with ``allowed(n)`` random edits (a word replaced, taken
    out or put in) and other words after them; the same for every item of that length.
    """
    import numpy as np

    most = allowed(n)
    if not most:
        return STEP
    rng = np.random.default_rng(n)
    windows = np.empty((TRIALS, n), np.int64)
    for t in range(TRIALS):
        words = list(range(n))
        for k in range(most):
            i, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[i : i + (kind != 2)] = [] if kind == 1 else [n + k]
        windows[t] = (words + list(range(2 * n, 3 * n)))[:n]
    item, met, done = np.arange(n)[None], np.zeros(TRIALS, bool), 0
    while met.mean() < RECALL:
        now = sampled(item, n, done, done + STEP)
        met |= (sampled(windows, n, done, done + STEP) == now).all(axis=2).any(axis=1)
        done += STEP
    return done


def distance_within(item: list, window: list, most: int) -> int:
    """Fewest word edits between the item and any stretch of the window; ``most + 1`` if more than ``most``."""
    import numpy as np

    codes: dict = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([codes.setdefault(w, len(codes)) for w in window])
    row = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (b != w)]))
        row = np.minimum.accumulate(new - steps) + steps
    return min(int(row.min()), most + 1)


class Items:
    """A block of benchmark items, prepared for search."""

    def __init__(self, rows: list[tuple[int, str]]):
        import numpy as np

        self.words: dict[str, int] = {}
        self.items = []
        for key, text in rows:
            w = normal_words(text)
            if w:
                self.items.append((key, [self.words.setdefault(x, len(self.words)) for x in w]))
        self.numbers = Numbers(self.words)
        self.base = np.int64(len(self.words) + 1)
        by_gram: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for k, (_, ids) in enumerate(self.items):
            g = min(GRAM, len(ids))
            for o in range(len(ids) - g + 1):
                by_gram.setdefault(g, {}).setdefault(tuple(ids[o : o + g]), []).append((k, o))
        #: by length: sums that may wrap, sorted, and the runs of words themselves
        self.grams = {g: (np.unique([functools.reduce(self._add, x, np.int64(0)) for x in runs]), runs) for g, runs in by_gram.items()}
        by_size: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            by_size.setdefault(len(ids), []).append(k)
        self.samples = {}
        for n, ks in by_size.items():
            ids = np.array([self.items[k][1] for k in ks])
            got = sampled(ids, n, 0, repeats(n))
            for k, sample in zip(ks, got, strict=True):
                self.samples[k] = sample

    def plain(self) -> dict:
        """What a broadcast carries: values that unpickle without this module."""
        return {k: v for k, v in vars(self).items() if k != "numbers"}

    @classmethod
    def of(cls, state: dict) -> Items:
        """The block in a worker; the words that it remembers stay with the broadcast's value from task to task."""
        out = cls.__new__(cls)
        out.__dict__ = state
        state.setdefault("numbers", Numbers(out.words))
        return out

    def _add(self, total, number: int):
        import numpy as np

        with np.errstate(over="ignore"):
            return total * self.base + np.int64(number)

    def search(self, ids) -> list[tuple[int, int, int]]:
        """(item key, first word, distance) of items that the document's word numbers hold.

        Word numbers, an array, are those of ``numbers``: -1 for a word that no item has.
        """
        import numpy as np

        starts: dict[int, set[int]] = {}
        n_words = len(ids)
        for size, (sums, grams) in self.grams.items():
            if n_words < size:
                continue
            spots = np.flatnonzero(ids >= 0)
            spots = spots[spots <= n_words - size]
            for o in range(1, size):
                spots = spots[ids[spots + o] >= 0]
            if not len(spots):
                continue
            total = np.zeros(len(spots), np.int64)
            for o in range(size):
                total = total * self.base + ids[spots + o]
            at = np.minimum(np.searchsorted(sums, total), len(sums) - 1)
            for p in spots[sums[at] == total].tolist():
                for k, o in grams.get(tuple(ids[p : p + size].tolist()), ()):
                    most = allowed(len(self.items[k][1]))
                    starts.setdefault(k, set()).update(range(max(0, p - o - most), p - o + most + 1))
        found = []
        padded = None
        for k, begin in starts.items():
            key, item = self.items[k]
            n, most = len(item), allowed(len(item))
            if padded is None:
                width = max(len(i) for _, i in self.items)
                padded = np.concatenate([ids, np.full(2 * width, -2, np.int64)])
            at = np.array(sorted(b for b in begin if b < n_words), np.int64)
            if not len(at):
                continue
            window = padded[at[:, None] + np.arange(n)]
            same = (window == np.asarray(item)).all(axis=1)
            if same.any():  # equal words take equal walks
                found.append((key, int(at[same.argmax()]), 0))
                continue
            best, where = most + 1, -1
            left = np.arange(len(at))
            for r in range(0, len(self.samples[k]), STEP):  # a window that has met the item needs no further walks
                hit = (sampled(window[left], n, r, r + STEP) == self.samples[k][r : r + STEP]).all(axis=2).any(axis=1)
                for b in at[left[hit]].tolist():
                    d = distance_within(item, ids[max(0, b - most) : b + n + most].tolist(), most)
                    if (d, b) < (best, where) or where < 0 and d <= most:
                        best, where = d, b
                left = left[~hit]
                if where >= 0 or not len(left):
                    break
            if where >= 0:
                found.append((key, where, best))
        return found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(key, text) of the benchmark in blocks of PASS_CHARS characters; the driver holds one block at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= PASS_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item, at, edits): benchmark items found in whole documents, once for each document and item.

    An item is found if some stretch of the document is within EDITS of its words, words compared in
    lower case and without marks at their ends; ``at`` is a word near which it stands, and ``edits`` the
    fewest of the windows that met it first. Null and empty texts hold nothing; items without words
    are never found; repeated rows are reported each; keys may be of any type. The benchmark is a stated
    query set: blocks of PASS_CHARS characters are held in the tasks in turn, against all documents. With
    more than one block, the rows of each are written to the shared folder before the next is read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", kinds[0]), T.StructField("item", kinds[1]), T.StructField("at", T.LongType()), T.StructField("edits", T.IntegerType())])
    types = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(block):
        def found(batches: Iterator) -> Iterator:
            import pyarrow as pa

            items = Items.of(block.value)
            for b in batches:
                ids, keys, ats, edits = [], [], [], []
                for n, t in enumerate(each(b.column(1))):
                    for key, at, d in items.search(items.numbers.of(t)):
                        ids.append(n), keys.append(key), ats.append(at), edits.append(d)
                columns = [b.column(0).take(pa.array(ids, pa.int64())), keys, ats, edits]
                yield pa.RecordBatch.from_arrays([columns[0].cast(types[0].type), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(types)[1:], strict=True))], names=types.names)

        return found

    out = spark.createDataFrame([], schema)
    held, parts = None, 0
    for block in item_blocks(benchmark, item_col, item_text):
        if held is not None:
            out = out.unionByName(materialize(held[0], "leaks"))
            parts += 1
            held[1].destroy()
        shared = spark.sparkContext.broadcast(Items(block).plain())
        held = rows.mapInArrow(scan(shared), schema), shared
    return out if held is None else out.unionByName(held[0]) if parts else held[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay. Decided row by row, without a shuffle.

    With a benchmark of more than one block, what is left after each is written to the shared folder.
    """
    spark = docs.sparkSession
    text_batches(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def clean(block):
        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            items = Items.of(block.value)
            for b in batches:
                yield b.filter(pa.array([not items.search(items.numbers.of(t)) for t in each(b.column(at))], pa.bool_()))

        return scan

    left, held = docs.toDF(*names), None
    for block in item_blocks(benchmark, item_col, item_text):
        if held is not None:
            left = materialize(left, "clean")
            held.destroy()
        held = spark.sparkContext.broadcast(Items(block).plain())
        left = left.mapInArrow(clean(held), left.schema)
    return left.toDF(*docs.columns)
