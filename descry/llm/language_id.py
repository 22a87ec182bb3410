"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over fixed windows of bytes, the maximum of
each filter over the window goes into a softmax. It is trained on a bounded sample: about
`per_language` labelled training rows with a letter for each language, at most `most_rows` in all,
chosen by hash; the languages learned are those of the sample. All windows of a text are scored, in
batches; the text's language is that of the highest mean log-probability, weighted by the windows'
bytes; of equal ones the first by name.

Null text or no letter: `und`, score 0. No labelled training row: `und`, score 0. Null lang: never
learned from. Null doc_id: not held out and not learned from. Repeated rows: one result each.
Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import written

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
#: Labelled rows for each language that training takes, about; the whole sample's limit; windows of each row.
PER_LANGUAGE, MOST_ROWS, SAMPLES = 1500, 20_000, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def to_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes (zeros after a text's end), each row's text and number of its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // WINDOW)
    out = np.zeros((int(rows.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, rows.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * WINDOW
    owner = np.repeat(np.arange(len(texts)), rows)
    last = np.cumsum(rows) - 1
    used = np.full(len(owner), WINDOW, np.int64)
    used[last[rows > 0]] = (sizes - (rows - 1) * WINDOW)[rows > 0]
    return out, owner, used


class ByteConv:
    """emb: 256 x E; conv: width x E x F for each width; out: 3F x languages."""

    def __init__(self, n_out: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (256, EMBED)).astype("f4")]
        self.p += [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype("f4") for w in WIDTHS]
        self.p += [np.zeros((len(WIDTHS), FILTERS), "f4"), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n_out)).astype("f4"), np.zeros(n_out, "f4")]

    def tables(self) -> list[np.ndarray]:
        """What each byte adds to the filters at each place of a width: width x 256 x F."""
        return [np.einsum("be,wef->wbf", self.p[0], c) for c in self.p[1 : 1 + len(WIDTHS)]]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        feats, args = [], []
        for k, (w, t) in enumerate(zip(WIDTHS, tables, strict=True)):
            n = x.shape[1] - w + 1
            a = t[0][x[:, :n]]
            for j in range(1, w):
                a += t[j][x[:, j : j + n]]
            at = a.argmax(axis=1)
            args.append(at)
            feats.append(np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p[-3][k], 0))
        return np.concatenate(feats, 1), args

    def features(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        feats = []
        for k, (w, t) in enumerate(zip(WIDTHS, tables, strict=True)):
            n = x.shape[1] - w + 1
            a = t[0].take(x[:, :n], axis=0)
            for j in range(1, w):
                a += t[j].take(x[:, j : j + n], axis=0)
            feats.append(np.maximum(a.max(axis=1) + self.p[-3][k], 0))
        return np.concatenate(feats, 1)

    @staticmethod
    def log_softmax(z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probs(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        return self.log_softmax(self.features(x, tables) @ self.p[-2] + self.p[-1])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.p[-1])), 1) / len(self.p[-1])).astype("f4")
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                grads, step = self.gradients(x[rows], y[rows], weight[y[rows]]), step + 1
                lr = rate * 0.6**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, a, b in zip(self.p, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= lr * a / (np.sqrt(b) + 1e-6)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        feats, args = self.pooled(x, self.tables())
        d = np.exp(self.log_softmax(feats @ self.p[-2] + self.p[-1]))
        d[np.arange(len(y)), y] -= 1
        d *= (weight / len(y))[:, None]
        g_feats = (d @ self.p[-2].T) * (feats > 0)
        g_emb, g_conv, g_bias = np.zeros_like(self.p[0]), [], np.zeros_like(self.p[-3])
        for k, (w, at) in enumerate(zip(WIDTHS, args, strict=True)):
            g = g_feats[:, k * FILTERS : (k + 1) * FILTERS]
            g_bias[k] = g.sum(0)
            conv = self.p[1 + k]
            g_w = np.zeros_like(conv)
            for j in range(w):
                byte = np.take_along_axis(x, at + j, 1)
                e = self.p[0][byte]
                g_w[j] = np.einsum("nfe,nf->ef", e, g)
                np.add.at(g_emb, byte, g[:, :, None] * conv[j].T[None])
            g_conv.append(g_w)
        return [g_emb, *g_conv, g_bias, feats.T @ d, d.sum(0)]


def sample(docs: DataFrame, per_language: int, most_rows: int) -> list[tuple[str, bytes]]:
    """Labelled draws of WINDOW characters from about per_language rows of each language, chosen by a hash of the id."""
    lettered = docs.filter(~F.col("held_out") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Written, so that its size is known: a few languages are sent to the scan, any number is joined.
    shares = written(lettered.groupBy("lang").agg((per_language / F.count(F.lit(1))).alias("share")), "languages")
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    rows = lettered.join(shares, "lang").filter(unit <= F.col("share")).orderBy(F.xxhash64("id"), "text").limit(most_rows)
    spot = lambda k: F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    return [(r["lang"], w.encode()) for r in rows.select("lang", F.array(*map(spot, range(SAMPLES))).alias("w")).toLocalIterator() for w in r["w"]]


def train(pairs: list[tuple[str, bytes]]) -> tuple[list[str], ByteConv | None]:
    langs = sorted({lang for lang, _ in pairs})
    if not langs:
        return [], None
    x, owner, _ = to_windows([w for _, w in pairs])
    y = np.array([langs.index(lang) for lang, _ in pairs])[owner]
    model = ByteConv(len(langs))
    model.fit(x, y)
    return langs, model


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> DataFrame:
    """id, held_out, lang_pred and score of each row, from its whole text alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col)).alias("held_out"))
    langs, model = train(sample(rows, per_language, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else []
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(2).to_pylist()]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if model and any(c.isalpha() for c in t)]
            for a in range(0, len(lettered), 64):
                part = lettered[a : a + 64]
                x, owner, used = to_windows([texts[i].encode() for i in part])
                total = np.zeros((len(part), len(langs)))
                for b in range(0, len(x), 32):
                    logp = model.log_probs(x[b : b + 32], tables) * used[b : b + 32, None]
                    np.add.at(total, owner[b : b + 32], logp)
                mean = total / np.bincount(owner, used, len(part))[:, None]
                prob = np.exp(ByteConv.log_softmax(mean))
                for i, best, p in zip(part, mean.argmax(1).tolist(), prob.max(1).tolist(), strict=True):
                    pred[i], score[i] = langs[best], min(1.0, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.select("id", "held_out", "text").mapInArrow(run, schema).withColumnRenamed("id", id_col)
