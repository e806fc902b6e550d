"""Quality classifier: a byte-level convolutional network in NumPy.

A text is cut into overlapping chunks that cover all of it. Learned filters slide over the bytes of a
chunk, each keeps its largest answer (max-pooling), and the largest, the mean and the smallest of
these over the chunks are combined into one probability. The smallest tells chunks that say little.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import each, text_batches

CHUNK, OVERLAP = 512, 64
DEPTH, SPAN, STEP, FILTERS = 4, 8, 2, 24
#: Chunks that pass the filters together; memory of a task does not depend on the text's length.
TOGETHER = 64
#: Labelled rows that the network is fitted on at most (their whole texts), rows of a step, and steps.
TRAIN_ROWS, BATCH, STEPS = 1500, 16, 1400


def chunks(text: str | None):
    """(n, CHUNK) bytes: overlapping chunks that cover the whole text, the last one padded with zeros."""
    import numpy as np

    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    whole = np.zeros((n - 1) * step + CHUNK, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.as_strided(whole, (n, CHUNK), (step, 1))


def new_net(seed: int = 7) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, DEPTH)),
        "filter": rng.normal(0, (2 / (SPAN * DEPTH)) ** 0.5, (SPAN * DEPTH, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.1, 3 * FILTERS),
        "base": np.zeros(1),
    }
    net["embed"][0] = 0
    return {k: v.astype(np.float32) for k, v in net.items()}


def _windows(net: dict, x):
    """(n, positions, SPAN * DEPTH) embedded bytes under each position of the filters."""
    import numpy as np

    e = net["embed"][x]
    n, positions = len(x), (CHUNK - SPAN) // STEP + 1
    a, b, c = e.strides
    return np.lib.stride_tricks.as_strided(e, (n, positions, SPAN * DEPTH), (a, b * STEP, c))


def pooled(net: dict, x):
    """(n, FILTERS) largest answers, not below zero, of each chunk; in blocks of a fixed size."""
    import numpy as np

    out = np.empty((len(x), FILTERS), np.float32)
    for at in range(0, len(x), TOGETHER):
        part = x[at : at + TOGETHER]
        if len(part) < TOGETHER:  # a fixed shape, so that equal chunks get equal answers
            part = np.concatenate([part, np.zeros((TOGETHER - len(part), CHUNK), np.uint8)])
        best = (np.ascontiguousarray(_windows(net, part)).reshape(-1, SPAN * DEPTH) @ net["filter"]).reshape(TOGETHER, -1, FILTERS).max(axis=1)
        out[at : at + TOGETHER] = np.maximum(best + net["bias"], 0)[: len(x) - at]
    return out


def probabilities(net: dict, answers, first):
    """One probability for each document, whose chunks begin at ``first``."""
    import numpy as np

    size = np.diff(np.append(first, len(answers)))
    both = np.concatenate([np.maximum.reduceat(answers, first), np.add.reduceat(answers, first) / size[:, None], np.minimum.reduceat(answers, first)], axis=1)
    return 1 / (1 + np.exp(-np.clip(both @ net["out"] + net["base"], -30, 30)))


def gradients(net: dict, x, size, y) -> tuple[float, dict]:
    """(mean logistic loss, its gradient by each part of the net) of documents with ``size`` chunks each.

    Gradients flow through the position and the chunk that won the pooling; equal winners share. Chunks pass
    TOGETHER at a time, so memory follows the number of chunks by a few hundred bytes each.
    """
    import numpy as np

    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(size)), size)
    best, top = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), net["filter"].dtype)
    for a in range(0, len(x), TOGETHER):
        answer = _windows(net, x[a : a + TOGETHER]) @ net["filter"]
        best[a : a + TOGETHER] = answer.argmax(axis=1)
        top[a : a + TOGETHER] = answer.max(axis=1)
    v = np.maximum(top + net["bias"], 0)
    high, low = np.maximum.reduceat(v, first), np.minimum.reduceat(v, first)
    mean = np.add.reduceat(v, first) / size[:, None]
    both = np.concatenate([high, mean, low], axis=1)
    z = np.clip(both @ net["out"] + net["base"], -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    d = (p - y) / len(size)
    grad = {"out": both.T @ d, "base": d.sum(keepdims=True), "filter": np.zeros_like(net["filter"]), "embed": np.zeros_like(net["embed"])}
    d_both = d[:, None] * net["out"][None]
    dv = d_both[doc, FILTERS : 2 * FILTERS] / size[doc, None]
    for won, d_won in ((v == high[doc], d_both[doc, :FILTERS]), (v == low[doc], d_both[doc, 2 * FILTERS :])):
        dv += won * d_won / np.add.reduceat(won.astype(np.float32), first)[doc]
    dv *= v > 0
    grad["bias"] = dv.sum(axis=0)
    for a in range(0, len(x), TOGETHER):
        part, d_part = x[a : a + TOGETHER], dv[a : a + TOGETHER]
        under = part[np.arange(len(part))[:, None, None], best[a : a + TOGETHER, :, None] * STEP + np.arange(SPAN)]  # (chunk, filter, SPAN) bytes
        seen = net["embed"][under].reshape(len(part), FILTERS, -1)
        grad["filter"] += np.einsum("mfk,mf->kf", seen, d_part)
        back = (d_part[:, :, None] * net["filter"].T[None]).reshape(-1, DEPTH)
        flat = under.ravel()
        grad["embed"] += np.stack([np.bincount(flat, back[:, k], 256) for k in range(DEPTH)], axis=1).astype(net["embed"].dtype)
    grad["embed"][0] = 0
    return loss, grad


def fit(texts: list[str], labels: list[int], *, steps: int = STEPS, seed: int = 7, rate: float = 4e-3, decay: float = 1e-4) -> dict:
    """Adam on the logistic loss over whole texts: ``steps`` steps of BATCH texts each, in rounds over all of them."""
    import numpy as np

    rng = np.random.default_rng(seed)
    net = new_net(seed)
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart: the rate of the labels
        net["out"][:] = 0
        net["base"][:] = 4.0 if len(y) and y[0] else (-4.0 if len(y) else 0.0)
        return net
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    queue: list[int] = []
    for step in range(1, steps + 1):
        if len(queue) < min(BATCH, len(y)):
            queue += rng.permutation(len(y)).tolist()
        pick, queue = queue[:BATCH], queue[BATCH:]
        parts = [chunks(texts[i]) for i in pick]
        _, grad = gradients(net, np.concatenate(parts), np.array([len(x) for x in parts]), y[pick])
        lr = rate * (1 - step / (steps + 1))
        for k in net:
            g = grad[k].astype(np.float32) + decay * net[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            net[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
        net["embed"][0] = 0
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label may not be learned from: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Fits the network on at most ``rows`` labelled documents outside the held-out fold, by a hash of the id.

    The sample is the only thing that is bounded and the only thing collected. Rows without a label or
    id do not count; without any labelled row every text scores one half. Ids may be of any type that sorts.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("_y"))
    picked = known.orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(rows)
    kind = labels.schema[id_col].dataType.simpleString()
    small = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in picked.collect()], f"_i {kind}, _y int")
    sample = docs.join(F.broadcast(small), docs[id_col] == small["_i"]).select("_i", "_y", F.col(text_col).alias("_t"))
    found = sorted((r["_i"], r["_t"] or "", r["_y"]) for r in sample.collect())
    return fit([t for _, t, _ in found], [int(y > 0) for _, _, y in found])


def score(docs: DataFrame, net: dict, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``: the probability that a whole text is good. Null and empty texts are one empty chunk.

    All rows and columns of ``docs`` are kept; if one of them is called ``name``, this is a ValueError.
    """
    if name in docs.columns:
        raise ValueError(f"{name}: there is such a column; choose another name")
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [f"c{i}" for i in range(len(docs.columns))]
    schema = docs.toDF(*kept).schema.add("score", "double")

    def batch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = np.empty(b.num_rows)
            held, first, begin, count = [], [], 0, 0

            def flush(stop, out=out):
                nonlocal held, first, begin, count
                if held:
                    out[begin:stop] = probabilities(net, pooled(net, np.concatenate(held)), np.array(first))
                held, first, begin, count = [], [], stop, 0

            for i, t in enumerate(each(b.column(at))):
                x = chunks(t)
                if len(x) > 4096:  # a very long text by itself, a strip at a time
                    flush(i)
                    strips = np.concatenate([pooled(net, x[k : k + 4096]) for k in range(0, len(x), 4096)])
                    out[i] = probabilities(net, strips, np.array([0]))[0]
                    begin = i + 1
                    continue
                held.append(x), first.append(count)
                count += len(x)
                if count >= 2048:
                    flush(i + 1)
            flush(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(out, 6))], names=[*kept, "score"])

    return docs.toDF(*kept).mapInArrow(batch, schema).toDF(*docs.columns, name)
