"""Language identification by a byte convolutional network.

Text is read as UTF-8 bytes in windows of a fixed length; convolutions of widths 2, 3 and 4 over byte
embeddings are max-pooled over each window, and a softmax over the pooled features gives the window's
languages. A document's probabilities are its windows' mean, weighted by their bytes, so the whole text
counts. The network is trained in numpy on a bounded sample of labelled texts; on the workers it runs as
table look-ups for byte pairs.

Null texts and texts without a letter are `und` with score 0. Rows with a null lang are not learned from; every
other lang value is. Without any labelled row every text is `und`. Repeated rows and equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import text_bytes
from .packing import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
STEP = WINDOW - max(WIDTHS) + 1  # windows overlap, so that every run of four bytes is seen once
#: Labelled documents the network is trained on, about as many (but LEAST of each language), and windows of each.
SAMPLE, LEAST = 6_000, 8
SAMPLE_WINDOWS = 3


@dataclass(frozen=True)
class Net:
    langs: tuple[str, ...]
    embed: np.ndarray  # (256, EMBED); byte 0 stays zero and pads
    filters: tuple[np.ndarray, ...]  # (width, EMBED, FILTERS) each
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the bytes at 0, 1 and those at 2, 3 add to each filter, by byte pair."""
        single = [[self.embed @ f[k] for k in range(len(f))] for f in self.filters]
        first = np.concatenate([(t[0][:, None] + t[1][None]).reshape(1 << 16, -1) for t in single], axis=1)
        zero = np.zeros((256, FILTERS), np.float32)
        late = [t + [zero] * (4 - len(t)) for t in single if len(t) > 2]
        second = np.concatenate([(t[2][:, None] + t[3][None]).reshape(1 << 16, -1) for t in late], axis=1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


def windows_of(n: int) -> int:
    """Windows that cover n bytes and at least three of padding."""
    return -(-(n + 3) // STEP)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Predictor:
    def __init__(self, net: Net):
        self.net, (self.first, self.second) = net, net.tables()

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages)"""
        out = np.zeros((len(texts), len(self.net.langs)))
        for lo, hi in slices(texts, 1 << 19):
            part = texts[lo:hi]
            counts = np.array([windows_of(len(t)) for t in part])
            buffer = b"".join(t.ljust(c * STEP, b"\0") for t, c in zip(part, counts.tolist(), strict=True)) + bytes(3)
            raw = np.frombuffer(buffer, np.uint8)
            pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
            starts = np.concatenate(([0], np.cumsum(counts)))
            probs = np.empty((starts[-1], len(self.net.langs)))
            for a in range(0, starts[-1], 1024):  # windows at a time
                b = min(a + 1024, starts[-1])
                at = slice(a * STEP, b * STEP)
                conv = self.first.take(pair[at], axis=0)
                conv[:, FILTERS:] += self.second.take(pair[a * STEP + 2 : b * STEP + 2], axis=0)
                pooled = np.maximum(conv.reshape(b - a, STEP, -1).max(axis=1) + self.net.bias, 0)
                probs[a:b] = _softmax(pooled @ self.net.out + self.net.out_bias)
            sizes = np.array([len(t) for t in part])
            weight = np.full(starts[-1], STEP, np.float64)
            weight[starts[1:] - 1] = np.maximum(sizes - (counts - 1) * STEP, 1e-3)
            total = np.add.reduceat(probs * weight[:, None], starts[:-1], axis=0)
            out[lo:hi] = total / total.sum(axis=1, keepdims=True)
        return out


def fit(windows: np.ndarray, target: np.ndarray, langs: tuple[str, ...], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> Net:
    """windows: (n, WINDOW) bytes, target: index of its language. Adam on the class-weighted cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))), "out_bias": np.zeros(len(langs))}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = len(target) / np.maximum(np.bincount(target, minlength=len(langs)), 1) / len(langs)
    t = 0
    for epoch in range(max(epochs, -(-400 * batch // max(len(target), 1)) if len(target) else 0)):
        order = rng.permutation(len(target))
        if epoch >= 4 * epochs:
            break
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x, y, n = windows[rows], target[rows], len(rows)
            conv = []
            for w in WIDTHS:
                parts = [(p["embed"] @ p[f"f{w}"][k])[x[:, k : k + STEP]] for k in range(w)]
                conv.append(sum(parts))
            conv = np.concatenate(conv, axis=2)  # (n, STEP, all filters)
            at = conv.argmax(axis=1)
            raw = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + p["bias"]
            pooled = np.maximum(raw, 0)
            probs = _softmax(pooled @ p["out"] + p["out_bias"])
            probs[np.arange(n), y] -= 1
            d = (probs * weight[y][:, None] / n).astype(np.float32)
            g = {"out": pooled.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            back = (d @ p["out"].T) * (raw > 0)
            g["bias"] = back.sum(0)
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                f, dz = p[f"f{w}"], back[:, cols]
                g[f"f{w}"] = np.zeros_like(f)
                for k in range(w):
                    seen = x[np.arange(n)[:, None], at[:, cols] + k]  # the byte under each filter's best place
                    e = p["embed"][seen]
                    g[f"f{w}"][k] = np.einsum("nfe,nf->ef", e, dz)
                    np.add.at(g["embed"], seen, dz[:, :, None] * f[k].T[None])
            g["embed"][0] = 0
            t += 1
            for name, v in g.items():
                m[name] = 0.9 * m[name] + 0.1 * v
                s[name] = 0.999 * s[name] + 0.001 * v * v
                p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Net(langs, p["embed"], tuple(p[f"f{w}"] for w in WIDTHS), p["bias"], p["out"], p["out_bias"])


def sample_windows(raw: bytes, most: int = SAMPLE_WINDOWS) -> list[bytes]:
    """Windows evenly spread over a whole text."""
    n = windows_of(len(raw))
    picked = sorted({i * n // most for i in range(most)})
    return [raw[i * STEP : i * STEP + WINDOW].ljust(WINDOW, b"\0") for i in picked if raw[i * STEP : i * STEP + WINDOW]]


def held_out(column="doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """Fits on about `sample` labelled documents, shared evenly by all languages and chosen by a hash of id and text.

    Rows equal in id, language and text count once, so no repeated row and no repeated id fills the sample or misses it whole.
    """
    ship_package(docs.sparkSession)
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out())
    known = known.withColumn("mark", F.xxhash64("doc_id", "lang", "text", F.lit(11)))
    counts = known.select("lang", "mark").distinct().groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return None
    langs = tuple(r["lang"] for r in counts)
    most = max(sample / len(langs), LEAST)
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], "lang string, share double")
    place = F.pmod("mark", F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.join(F.broadcast(share), "lang").where(place < F.col("share"))
    chosen = chosen.groupBy("lang", "mark").agg(F.first("doc_id").alias("doc_id"), F.first(text_bytes()).alias("text")).select("doc_id", "lang", "text")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, g, w) for d, g, t in pdf.itertuples(index=False) for w in sample_windows(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "window"])

    rows = chosen.mapInPandas(pick, "doc_id long, lang string, window binary").toPandas().sort_values(["doc_id", "lang", "window"])
    if not len(rows):
        return None
    windows = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    index = {g: i for i, g in enumerate(langs)}
    return fit(windows, rows["lang"].map(index).to_numpy(), langs)


_predictors: dict[int, tuple[Net, Predictor]] = {}


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with lang_pred and score (in place of columns so named)."""
    unknown = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    if net is None:
        return unknown

    ship_package(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(net)
        for t in texts:
            probs = predictor.probabilities(t.tolist())
            best = probs.argmax(axis=1) if len(probs) else np.zeros(0, int)
            yield pd.DataFrame({"lang": [net.langs[i] for i in best], "score": probs.max(axis=1) if len(probs) else []})

    rated = docs.withColumn("__p", predict.asNondeterministic()(text_bytes()))
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return (
        rated.withColumn("lang_pred", F.when(letter, F.col("__p.lang")).otherwise("und"))
        .withColumn("score", F.when(letter, F.least(F.col("__p.score"), F.lit(1.0))).otherwise(0.0))
        .drop("__p")
    )
