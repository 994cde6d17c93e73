"""Quality classification with a small byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks that cover the whole text; each
filter's maximum in a chunk is kept; means and maxima over all chunks give one probability.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from terralith.llm import _text as T

#: A filter sees WIDTH bytes and moves by STRIDE; a block is BLOCK places, a chunk BLOCKS blocks, one of them shared with the next.
WIDTH, STRIDE, BLOCK, BLOCKS, DIM, FILTERS = 12, 2, 16, 8, 4, 24
PLACES = BLOCK * BLOCKS
CHUNK_BYTES = (PLACES - 1) * STRIDE + WIDTH
STEP_BYTES = (BLOCKS - 1) * BLOCK * STRIDE
#: Places that are filtered at a time.
PART = 2048
#: At most so many labelled texts are used to fit, each of them whole.
FIT_ROWS = 3000
#: Chunks that go through the filters at a time when the net is fitted.
FIT_PART = 256
#: Weights under the maxima are multiples of 2^-GRID, of at most LIMIT: sums of WIDTH*DIM products of two are exact in 53 bits.
GRID, LIMIT = 20, 8.0


class Net(NamedTuple):
    embed: np.ndarray  # byte x DIM
    filters: np.ndarray  # WIDTH*DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2*FILTERS: of the means, of the maxima
    last: float


def on_grid(weights: np.ndarray) -> np.ndarray:
    """The nearest weights whose products add up without rounding."""
    return np.ldexp(np.rint(np.ldexp(np.clip(weights, -LIMIT, LIMIT), GRID)), -GRID).astype(np.float32)


def activations(filters: np.ndarray, flat: np.ndarray, places: int) -> np.ndarray:
    """Each filter at each place of embedded bytes, rounded once: no order in which a product is added up changes a bit."""
    view = np.lib.stride_tricks.as_strided(flat, (places, WIDTH * DIM), (STRIDE * DIM * 4, 4), writeable=False)
    return (view.astype(np.float64, order="C") @ filters.astype(np.float64)).astype(np.float32)


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means and maxima over chunks of each filter's maximum, a row a text."""
    sizes = np.diff(offsets)
    places = np.maximum(0, sizes - WIDTH) // STRIDE + 1
    places += (sizes > WIDTH) & ((sizes - WIDTH) % STRIDE > 0)
    blocks = -(-places // BLOCK)
    # the last place can reach beyond the text's blocks: room for all its bytes, so that no text lies over another's
    room = np.maximum(blocks, -(-sizes // (BLOCK * STRIDE)))
    start = np.concatenate([[0], np.cumsum(room)])
    n = start[-1] * BLOCK
    parts = -(-n // PART)
    buffer = np.zeros(parts * PART * STRIDE + WIDTH, np.uint8)
    to = np.repeat(start[:-1] * BLOCK * STRIDE, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    buffer[to] = data
    flat = net.embed[buffer].ravel()
    act = np.concatenate([activations(net.filters, flat[k * PART * STRIDE * DIM :], PART) for k in range(parts)])[:n]
    place = np.arange(n) - np.repeat(start[:-1] * BLOCK, room * BLOCK)
    act[place >= np.repeat(places, room * BLOCK)] = -1e9
    act = np.maximum(act.reshape(-1, BLOCK, FILTERS).max(1) + net.bias, 0)
    chunks = np.maximum(1, -(-(blocks - 1) // (BLOCKS - 1)))
    first = np.concatenate([[0], np.cumsum(chunks)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
    top = None
    for j in range(BLOCKS):
        at = np.minimum(np.repeat(start[:-1], chunks) + k * (BLOCKS - 1) + j, np.repeat(start[:-1] + blocks - 1, chunks))
        top = act[at] if top is None else np.maximum(top, act[at])
    return np.concatenate([np.add.reduceat(top, first[:-1]) / chunks[:, None], np.maximum.reduceat(top, first[:-1])], axis=1)


def scores(net: Net, column: pa.Array) -> np.ndarray:
    data, offsets = T.utf8(column)
    out = []
    for i, j in T.slices(offsets, 1 << 16):
        lo = offsets[i]
        x = pooled(net, data[lo : offsets[j]], offsets[i : j + 1] - lo)
        out.append(1 / (1 + np.exp(-np.clip((x * net.out).sum(1) + net.last, -30, 30))))
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def chunks_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of a text's chunks, as rows of bytes, and how many places each has."""
    places = -(-max(0, len(text) - WIDTH) // STRIDE) + 1
    n = max(1, -(-(-(-places // BLOCK) - 1) // (BLOCKS - 1)))
    padded = np.zeros((n - 1) * STEP_BYTES + CHUNK_BYTES + WIDTH, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.as_strided(padded, (n, CHUNK_BYTES), (STEP_BYTES, 1), writeable=False)
    return rows, np.minimum(places - np.arange(n) * (STEP_BYTES // STRIDE), PLACES)


def strongest(embed: np.ndarray, filters: np.ndarray, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk and filter the greatest activation and its place."""
    act, best = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for at in range(0, len(x), FIT_PART):
        flat = np.ascontiguousarray(embed[x[at : at + FIT_PART]])
        m = len(flat)
        view = np.lib.stride_tricks.as_strided(flat, (m, PLACES, WIDTH * DIM), (flat.strides[0], STRIDE * DIM * 4, 4), writeable=False)
        a = (np.ascontiguousarray(view).reshape(m * PLACES, -1) @ filters).reshape(m, PLACES, FILTERS)
        a[np.arange(PLACES) >= places[at : at + m, None]] = -1e9
        best[at : at + m] = a.argmax(1)
        act[at : at + m] = np.take_along_axis(a, best[at : at + m, None, :], 1)[:, 0]
    return act, best


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 64, seed: int = 3) -> Net:
    """From whole texts and their labels, by backpropagation with Adam; a filter's gradient goes to the place of its maximum."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.25, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    if not texts:
        return Net(on_grid(net[0]), on_grid(net[1]), *net[2:4], 0.0)
    parts = [chunks_of(t) for t in texts]
    y_all = np.array(labels, np.float32)
    share = float(np.clip(y_all.mean(), 0.01, 0.99))
    net[4][0] = np.log(share / (1 - share))
    m, v, t = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // batch)):
            x, places = (np.concatenate([parts[i][k] for i in rows]) for k in range(2))
            n = np.array([len(parts[i][1]) for i in rows])
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            doc = np.repeat(np.arange(len(rows)), n)
            act, best = strongest(net[0], net[1], x, places)
            top = np.maximum(act + net[2], 0)
            mean, most = np.add.reduceat(top, first) / n[:, None], np.maximum.reduceat(top, first)
            hidden = np.concatenate([mean, most], 1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net[3] + net[4], -30, 30)))
            g = ((p - y_all[rows]) / len(rows)).astype(np.float32)
            d_top = (g / n)[doc][:, None] * net[3][:FILTERS]
            is_most = top == most[doc]
            is_most = is_most / np.maximum(np.add.reduceat(is_most.astype(np.float32), first)[doc], 1)
            d_top = (d_top + g[doc][:, None] * net[3][FILTERS:] * is_most) * (top > 0)
            grad = [np.zeros_like(q) for q in net]
            # the bytes under each maximum
            at = best[:, :, None] * STRIDE + np.arange(WIDTH)
            under = x[np.arange(len(x))[:, None, None], at]
            seen = net[0][under].reshape(len(x), FILTERS, WIDTH * DIM)
            grad[1] = np.einsum("cf,cfk->kf", d_top, seen) + 1e-4 * net[1]
            grad[2] = d_top.sum(0)
            grad[3] = hidden.T @ g + 1e-4 * net[3]
            grad[4][0] = g.sum()
            back = (d_top[:, :, None] * net[1].T[None]).reshape(-1, DIM)
            for k in range(DIM):
                grad[0][:, k] = np.bincount(under.ravel(), back[:, k], 256)
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for i, q in enumerate(net):
                m[i], v[i] = 0.9 * m[i] + 0.1 * grad[i], 0.999 * v[i] + 0.001 * grad[i] ** 2
                q -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)
    return Net(on_grid(net[0]), on_grid(net[1]), *net[2:4], float(net[4][0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Net:
    """Fits on at most about fit_rows labelled rows among those where learn holds, on their whole texts."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull())
    count = known.where(learn).count()
    if not count:
        return fit([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(learn & (draw < min(1.0, fit_rows / count)))
    # the labels drawn are bounded by fit_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    got = sorted(((r["text"] or "").encode(), r["quality"]) for r in rows.select("quality", "text").collect())
    return fit([t for t, _ in got], [q for _, q in got])


def judge(docs: DataFrame, net: Net, least: float = 0.3) -> DataFrame:
    """All rows of docs with score (0 to 1) and predicted (1 if score is at least least).

    docs: text and any other columns; score and predicted replace columns of these names. Text alone decides,
    all of it; a null or empty text is scored as such. Equal texts have equal scores. An empty table gives an
    empty result.
    """
    docs = docs.drop("score", "predicted")
    schema = st.StructType([*docs.schema.fields, st.StructField("score", st.DoubleType()), st.StructField("predicted", st.IntegerType())])

    def run(batches):
        for b in batches:
            s = scores(net, b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(T.lean(run), schema)


def held_out() -> Column:
    return T.crc_part("doc_id", 5) == 0


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs, labels, ~held_out())
    return judge(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
