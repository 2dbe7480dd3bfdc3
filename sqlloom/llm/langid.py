"""Language identification by a byte convolutional network written and trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom.llm.common import utf8

UNDETERMINED = "und"
WIDTHS = (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
#: Letters A-Z read as a-z and digits as one digit, so that case and numbers carry no signal.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_ROWS = 64  # windows convolved at a time


@dataclass
class ByteNetwork:
    """Embedding, one convolution per width, max over the window, softmax."""

    languages: list[str]
    window: int
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def _convolved(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dim = self.embedding.shape[1]
        flat = self.embedding[windows].reshape(len(windows), -1)
        for w, f, b in zip(WIDTHS, self.filters, self.offsets):
            seen = np.lib.stride_tricks.sliding_window_view(flat, w * dim, axis=1)[:, ::dim]
            columns = seen.reshape(-1, w * dim)
            yield seen, columns @ f + b, np.array(seen.shape[:2])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        parts = [h.reshape(*shape, -1).max(axis=1) for _, h, shape in self._convolved(windows)]
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of every window; windows are convolved a few at a time."""
        out = np.empty((len(windows), len(self.languages)), np.float64)
        for at in range(0, len(windows), _ROWS):
            z = (self.pooled(windows[at:at + _ROWS]) @ self.weights + self.bias).astype(np.float64)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at:at + _ROWS] = z / z.sum(axis=1, keepdims=True)
        return out


def windows_of(text: bytes, window: int) -> np.ndarray:
    """All windows of a text: fixed length, overlapping by the widest filter less one, zero-padded at the end."""
    step = window - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[:len(text)] = _FOLD[np.frombuffer(text, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::step]


def train(rows: list[tuple[bytes, str]], window: int = 256, dim: int = 6, filters: int = 16, epochs: int = 6,
          batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNetwork | None:
    """Fit on (window text, language) rows by Adam; None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    x = np.stack([windows_of(t, window)[0] for t, _ in rows])
    y = np.array([languages.index(lang) for _, lang in rows])
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = ByteNetwork(languages, window, rng.normal(0, 0.5, (256, dim)).astype(np.float32), [near(w * dim, filters) for w in WIDTHS],
                      [np.zeros(filters, np.float32) for _ in WIDTHS], near(len(WIDTHS) * filters, len(languages)), np.zeros(len(languages), np.float32))
    params = [net.embedding, *net.filters, *net.offsets, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at:at + batch]
            xs, n = x[pick], len(pick)
            views, tops, peaks = [], [], []
            for seen, h, shape in net._convolved(xs):
                h = h.reshape(*shape, -1)
                peak = h.argmax(axis=1)
                views.append(seen)
                peaks.append(peak)
                tops.append(np.take_along_axis(h, peak[:, None], axis=1)[:, 0])
            pooled = np.maximum(np.concatenate(tops, axis=1), 0)
            z = pooled @ net.weights + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p /= n
            back = (p @ net.weights.T) * (pooled > 0)
            grads_f, grads_b, grad_e = [], [], np.zeros_like(net.embedding)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * filters:(k + 1) * filters]
                taken = views[k][np.arange(n)[:, None], peaks[k]]  # only the peak of each filter carries a gradient
                grads_f.append(np.einsum("nf,nfd->df", g, taken))
                grads_b.append(g.sum(axis=0))
                spread = (g[:, :, None] * net.filters[k].T[None]).reshape(n, filters, w, dim)
                for j in range(w):
                    np.add.at(grad_e, xs[np.arange(n)[:, None], peaks[k] + j], spread[:, :, j])
            step += 1
            for i, g in enumerate([grad_e, *grads_f, *grads_b, pooled.T @ p, p.sum(axis=0)]):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, learn: Column, window: int, per_language: int, per_document: int, seed: int) -> list[tuple[bytes, str]]:
    """A bounded sample: for each language the documents with the smallest hash, a few windows at hashed places of each.

    Ranking sees identifiers and languages only, each task passing on its own smallest hashes; the texts of
    the few chosen documents are read in a second scan.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    hashed = F.xxhash64(F.lit(seed), "doc_id").alias("_h")
    chosen = (
        docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", hashed)
        .withColumn("_r", rank).where(F.col("_r") <= per_language)
        .select(F.col("doc_id").alias("_chosen"), "_h").distinct()
    )
    raw = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("_raw") - window, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("_h", "_w"), room).cast("int") + 1
    taken = (  # per_language rows for each language, so the broadcast is bounded
        docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_chosen"))
        .where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("lang", raw.alias("_raw"), "_h", F.explode(F.sequence(F.lit(0), F.lit(per_document - 1))).alias("_w"))
        .select("lang", F.substring("_raw", place, F.lit(window)).alias("raw"))
    )
    return sorted((bytes(r["raw"]), r["lang"]) for r in taken.collect())


def identify(docs: DataFrame, learn: Column, window: int = 256, per_language: int = 800, per_document: int = 3, seed: int = 11) -> DataFrame:
    """``row`` (a struct of the document's columns, so no name can clash), ``lang_pred`` and ``score`` of every document.

    The network learns from at most ``per_language`` documents of each language for which ``learn`` holds and ``lang``
    is not null (``per_document`` windows each; only these bounded windows come to the driver).  It is
    applied to all windows of every whole text; a text's score is the mean over its windows of the predicted
    language's probability, ties going to the first language in order.  Identifier, language and source are no inputs.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when there is nothing to
    learn from.  Rows of a null ``doc_id`` and repeated rows are predicted like others, extra columns are
    carried, an empty table gives an empty result.  No row is shuffled.
    """
    net = train(training_rows(docs, learn, window, per_language, per_document, seed), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for text, letters in zip(batch.column(0).field("text"), batch.column(1)):
                if net is None or not letters.as_py():
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                raw, total, n = utf8(text.as_py()), np.zeros(len(net.languages)), 0
                block = 4096 * (window - OVERLAP)  # bounded memory for a very long text
                for at in range(0, max(1, len(raw) - OVERLAP), block):
                    cut = windows_of(raw[at:at + block + OVERLAP], window)
                    total += net.probabilities(cut).sum(axis=0)
                    n += len(cut)
                best = int(total.argmax())
                found.append(net.languages[best])
                scores.append(float(min(1.0, total[best] / n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             names=["row", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), letters.alias("_letters"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, learn: Column, least: float = 0.3) -> DataFrame:
    """The documents with a language: those that are ``und``, or whose score is below ``least``, go; columns as they come."""
    kept = identify(docs, learn).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select("row.*")
