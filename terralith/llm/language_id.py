"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier for each bit, a logistic regression on hashed byte
n-grams of the whole text, predicts that bit. Decoding adds up each bit's logistic loss against a
codeword, weighted by how well the bit was learned, and takes the codeword of least loss; a small lead
over the next one marks the text as ambiguous.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from terralith.llm import _text as T

FEATURES = 4096
#: At most so many labelled texts of each language are used to fit; more change little.
FIT_ROWS = 600
#: At most so many languages are learned, those of most labelled texts.
MOST_LANGS = 200
NONE = "und"


class Model(NamedTuple):
    names: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: counts of its hashed one to three byte n-grams (A-Z as a-z), damped and scaled to length 1."""
    data, offsets = T.utf8(column)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, j in T.slices(offsets):
        lo, hi = offsets[i], offsets[j]
        x = T.FOLD[data[lo:hi]].astype(np.uint32)
        row = np.repeat(np.arange(j - i, dtype=np.int64) * FEATURES, np.diff(offsets[i : j + 1]))
        gram = np.zeros(len(x), np.uint32)
        count = np.zeros((j - i) * FEATURES)
        for n in range(1, 4):
            if len(x) < n:
                break
            gram = gram[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
            same = row[: len(gram)] == row[n - 1 :]
            at = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            count += np.bincount((row[: len(gram)] + at)[same], minlength=len(count))
        out[i:j] = np.sqrt(count).reshape(j - i, FEATURES)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits in two for up to five languages, else the best found of random ones."""
    if n <= 5:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(max(1, 2 ** (n - 1) - 1))] for i in range(n)])
    rng, bits, best = np.random.default_rng(7), int(10 * np.ceil(np.log2(n))), None
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        apart = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, m)
    return best[1]


def fit(x: np.ndarray, y: list[str], steps: int = 150) -> Model:
    names = sorted(set(y))
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1), np.ones(1))
    codes = codewords(len(names))
    of = np.array([names.index(v) for v in y])
    target = codes[of].astype(np.float32)
    share = np.bincount(of, minlength=len(names))[of].astype(np.float32)
    row_weight = (1 / share / len(names))[:, None]
    w, b = np.zeros((FEATURES, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v = np.zeros((FEATURES + 1, codes.shape[1]), np.float32), np.zeros((FEATURES + 1, codes.shape[1]), np.float32)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * row_weight
        step = np.concatenate([x.T @ g + 1e-5 * w, g.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        move = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    error = ((np.sign(x @ w + b) != target) * row_weight).sum(0)
    return Model(names, codes, w, b, np.maximum(0.05, 1 - 2 * error))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, how likely it is by its loss, and its lead over the next."""
    margin = x @ model.weights + model.bias
    loss = (np.log1p(np.exp(-np.clip(margin[:, None, :] * model.codes, -30, 30))) * model.trust).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    order = np.sort(p, axis=1)
    return p.argmax(1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def train(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS, most_langs: int = MOST_LANGS) -> Model:
    """Fits on at most fit_rows texts a language (and about as many again at most) among rows where learn holds and lang isn't null.

    At most most_langs languages, those of most such rows, are learned (ties: the lesser name).
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.2 * fit_rows / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def collect(batches):
        schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())])
        for b in batches:
            x = features(b.column("text"))
            at = [np.flatnonzero(r) for r in x]
            yield T.batch(schema, b.column("lang"), [a.astype(np.uint16).tobytes() for a in at], [r[a].tobytes() for r, a in zip(x, at, strict=True)])

    got = rows.where(draw < share).select("lang", "text").mapInArrow(T.lean(collect), "lang string, at binary, value binary").collect()
    got = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in got)
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, (_, at, value) in zip(x, got, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit(x, [lang for lang, _, _ in got])


def identify(docs: DataFrame, model: Model, lead: float = 0.2) -> DataFrame:
    """All rows of docs with lang_pred, score (0 to 1) and ambiguous.

    docs: text and any other columns; lang_pred, score and ambiguous replace columns of these names. Text alone
    decides, all of it. A null, empty or letterless text gets und, score 0; so does every text if the model has
    seen no language. Equal texts have equal results. An empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = st.StructType([*docs.schema.fields, st.StructField("lang_pred", st.StringType()), st.StructField("score", st.DoubleType()), st.StructField("ambiguous", st.BooleanType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                more = named(model, b.column("text"), lead)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(T.lean(run), schema)


def named(model: Model, texts: pa.Array, lead: float = 0.2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the language or und, the score and whether it is ambiguous."""
    letters = np.array([has_letter(t) for t in texts.to_pylist()], bool) & bool(model.names)
    if not model.names:
        return [NONE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    name, score, gap = decode(model, features(texts))
    return [model.names[k] if ok else NONE for k, ok in zip(name.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0), (gap < lead) | ~letters


def speaking(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns whatever their names, whose text has a language as identify() has it."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                names = named(model, b.column("text"))[0]
                yield b.filter(pa.array([x != NONE for x in names], pa.bool_()))

    return docs.mapInArrow(T.lean(run), st.StructType(docs.schema.fields))


def held_out() -> Column:
    return T.crc_part("doc_id", 3) == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"), ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
