"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Every byte has an embedding; filters
of several widths slide over a window, each passes on its largest value (rectified), and a softmax
over these gives the window's probabilities. A text's are the means over all of its windows, weighted
by their bytes. The network is trained with numpy on windows of at most ``SAMPLE`` labelled texts, as
many of each language where there are so many, so that the fit takes the driver the same few seconds
at any size; all windows of every text are predicted.

A filter over embeddings is a sum of tables by byte, so prediction multiplies nothing per byte: the
tables of a filter's neighbouring bytes are merged into tables by pairs of bytes, and a window's
convolution is looked up and added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled texts that the network is trained on, at most; languages, the most frequent ones; windows of a text.
SAMPLE, LANGUAGES, EACH = 4_000, 400, 4
EPOCHS, BATCH, RATE = 8, 32, 4e-3
HELD_OUT = 0
UNDETERMINED = "und"
#: Fills windows up; bytes are 0 to 255.
PAD = 256
#: Windows that are looked up at once: their values stay in a core's cache.
BLOCK = 32


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    embedding: np.ndarray  # PAD + 1, EMBEDDING
    filters: tuple[np.ndarray, ...]  # by width: width, EMBEDDING, FILTERS
    bias: np.ndarray  # of all filters
    dense: np.ndarray  # all filters, languages
    offset: np.ndarray  # languages

    def tables(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The first two bytes' table of all filters by pair, and what is added to a width's filters by pairs (or a byte) further on."""
        byte = [np.einsum("be,wef->wbf", self.embedding, f).astype(np.float32) for f in self.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, a.shape[1])
        first = np.concatenate([pair(t[0], t[1]) for t in byte], axis=1) + self.bias.astype(np.float32)
        rest = []
        for k, t in enumerate(byte):
            for j in range(2, len(t), 2):
                rest.append((k, j, pair(t[j], t[j + 1]) if j + 1 < len(t) else t[j]))
        return np.ascontiguousarray(first), rest

    def probabilities(self, windows: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Of each of ``windows`` (bytes or PAD), a row."""
        first, rest = tables or self.tables()
        n = FILTERS
        top = np.zeros((len(windows), n * len(WIDTHS)), np.float32)
        reach = max(WIDTHS)
        for at in range(0, len(windows), BLOCK):
            x = windows[at : at + BLOCK].astype(np.int32)
            x = np.concatenate([x, np.full((len(x), reach), PAD, np.int32)], axis=1)
            pairs = x[:, :-1] * (PAD + 1) + x[:, 1:]
            y = first.take(pairs[:, :WINDOW], axis=0)
            for k, j, t in rest:
                key = pairs if len(t) > PAD + 1 else x
                y[:, :, n * k : n * (k + 1)] += t.take(key[:, j : j + WINDOW], axis=0)
            top[at : at + BLOCK] = y.max(axis=1)
        return softmax(np.maximum(top, 0) @ self.dense + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one filled up; one at least."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def trained(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Network:
    """The network of windows ``x`` with the numbers of their languages ``y``, by Adam on the cross entropy.

    Every other window of a batch is cut to a random length, so that short texts are learnt as well.
    """
    rng = np.random.default_rng(seed)
    n, k = FILTERS * len(WIDTHS), len(languages)
    values = [rng.normal(0, 0.5, (PAD + 1, EMBEDDING))]
    values += [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS]
    values += [np.zeros(n), rng.normal(0, 1 / np.sqrt(n), (n, k)), np.zeros(k)]
    moments, step = [(np.zeros_like(v), np.zeros_like(v)) for v in values], 0
    reach = max(WIDTHS)
    for _ in range(EPOCHS if k > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            b = x[own].astype(np.int64)
            cut = rng.integers(8, WINDOW, len(b))
            cut[::2] = WINDOW
            b[np.arange(WINDOW)[None] >= cut[:, None]] = PAD
            b = np.concatenate([b, np.full((len(b), reach), PAD)], axis=1)
            e, *fs, bias, dense, offset = values
            grads = [np.zeros_like(v) for v in values]
            rows = np.arange(len(b))[:, None]
            tops, patches = [], []
            for w, f in zip(WIDTHS, fs):
                sums = sum(e[b[:, j : j + WINDOW]] @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w))
                place = sums.argmax(axis=1)  # window, filter
                tops.append(np.take_along_axis(sums, place[:, None], axis=1)[:, 0])
                patches.append(b[rows[:, :, None], place[:, :, None] + np.arange(w)])
            z = np.concatenate(tops, axis=1) + bias
            hidden = np.maximum(z, 0)
            slope = softmax(hidden @ dense + offset)
            slope[np.arange(len(b)), y[own]] -= 1
            slope /= len(b)
            grads[-2], grads[-1] = hidden.T @ slope, slope.sum(axis=0)
            dz = (slope @ dense.T) * (z > 0)
            grads[-3] = dz.sum(axis=0)
            for i, (w, f, patch) in enumerate(zip(WIDTHS, fs, patches)):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                taken = e[patch].reshape(len(b), FILTERS, -1)
                grads[1 + i] = np.einsum("bf,bfp->pf", d, taken)
                back = (d[:, :, None] * f.T[None]).reshape(-1, EMBEDDING)
                np.add.at(grads[0], patch.ravel(), back)
            step += 1
            for v, g, (m, s) in zip(values, grads, moments):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    e, *fs, bias, dense, offset = values
    shaped = tuple(f.reshape(w, EMBEDDING, FILTERS) for w, f in zip(WIDTHS, fs))
    return Network(languages, e, shaped, bias, dense.astype(np.float32), offset.astype(np.float32))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from the network: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """The network of the rows of ``docs`` that have an id, a text with letters and a lang, and are not held out.

    Of each language as many texts are taken by a hash of id and text, ``sample`` in all; equal rows count as one.
    """
    known = docs.where("doc_id is not null and lang is not null").where(~held_out()).where(F.rlike("text", F.lit(r"\p{L}")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = tuple(sorted(r["lang"] for r in counts))
    if not names:
        return Network((), np.zeros((PAD + 1, EMBEDDING)), (), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(1, sample // len(names))
    shares = [(r["lang"], min(1.0, each / r["n"])) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, _share double")  # LANGUAGES rows at most
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / 2.0**53
    chosen = known.select("lang", "text", place.alias("_h")).join(F.broadcast(shares), "lang").where("_h < _share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                own = windows(text.as_py().encode())
                own = own[np.unique(np.linspace(0, len(own) - 1, EACH).astype(int))]
                found.append(own.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_h"), pa.array(found, pa.binary())], ["lang", "h", "w"])

    rows = chosen.mapInArrow(run, "lang string, h double, w binary").dropDuplicates(["lang", "h"])
    # the shares leave about ``sample`` texts
    rows = rows.orderBy("h", "lang").limit(2 * sample).collect()
    parts = [np.frombuffer(r["w"], "<i2").reshape(-1, WINDOW) for r in rows]
    y = np.repeat([names.index(r["lang"]) for r in rows], [len(p) for p in parts])
    return trained(np.concatenate(parts), y, names)


def identified(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; see ``identify``."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = network.languages, network.tables() if network.languages else None
        for batch in batches:
            found, scores = [], []
            for text, letters in zip(batch.column("text"), batch.column("letters")):
                if not names or not letters.as_py():
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                data = text.as_py().encode()
                own = windows(data)
                weight = np.full(len(own), float(WINDOW))
                weight[-1] = len(data) - WINDOW * (len(own) - 1)
                mean = weight @ network.probabilities(own, tables) / weight.sum()
                best = int(mean.argmax())
                found.append(names[best])
                scores.append(min(1.0, float(mean[best])))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text", letters.alias("letters")).mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred (a language of the labelled rows) and score of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if no row is
    labelled; with one language only, all others get it. Texts of any length are predicted whole; of
    languages with equal means the first by name is taken. Repeated rows get equal predictions and
    are learnt from once; a null doc_id is not held out, and not learnt from; an empty table gives an
    empty result; only doc_id, text and lang are read.
    """
    return identified(docs, fitted(docs, sample))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of the whole ``documents`` table."""
    return identify(table(spark, sf_dir, "documents"))
