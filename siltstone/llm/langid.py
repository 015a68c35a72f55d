"""Language of documents by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, each forwards and backwards, with the state carried
from byte to byte across words, spaces and lines. At each byte the two states give a probability
for each language; a document's probabilities are the mean over all its bytes that may belong to a
letter, and the likeliest language is predicted. Every byte of a text is read. Windows of a slice
run side by side, longest first, so that those still going on are always the first columns.

Training (numpy, backpropagation through time, Adam, fixed seeds) uses a bounded sample: of each
language ``SAMPLE_DOCS`` documents, those with the smallest hashes, and of each document
``SAMPLE_WINDOWS`` stretches of ``TRAIN_WINDOW`` bytes, evenly spread over it. Only these stretches
reach the driver. Of more than ``MAX_LANGUAGES`` languages the most frequent ones are learned.

Cases: lang is ``und`` and score 0 for a null text, a text without a letter, and every text when
no labelled row is left to learn from; a null lang or null doc_id is never learned from; a null
doc_id is not held out; rows that repeat a doc_id share the sample's bound; an empty table gives no
row; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.words import raw, slices
from siltstone.llm.worker import held, release, tidy
from siltstone.session import fresh_name, ship, small_batches

SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_WINDOW, MAX_LANGUAGES = 300, 4, 160, 500
EPOCHS, BATCH, RATE = 5, 128, 0.01
HIDDEN, WINDOW = 12, 512
#: Windows that run side by side.
COLUMNS = 1024
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MAYBE = _LETTER.copy()
_MAYBE[0x80:] = True


@dataclass
class Model:
    """For each direction: input table (3H, 256), recurrent (3H, H), bias of the candidate's recurrent part (H, 1)."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> "Model":
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
            w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
            w[f"c{d}"] = np.zeros((hidden, 1))
            w[f"o{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (len(languages), hidden))
        w["bias"] = np.zeros((len(languages), 1))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})


def _run(w: dict, d: str, x: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """What each byte's state gives the languages, (T, L, B).

    x: bytes (T, B) in the order they are read; ``sizes`` (descending): how many of a column count.
    """
    hidden = w[f"c{d}"].shape[0]
    table, rec, bias, out_w = w[f"x{d}"], w[f"h{d}"], w[f"c{d}"], w[f"o{d}"]
    h = np.zeros((hidden, x.shape[1]), np.float32)
    out = np.zeros((len(x), len(out_w), x.shape[1]), np.float32)
    active = np.searchsorted(-sizes, -np.arange(len(x)), "left")  # columns longer than t
    for t in range(len(x)):
        m = int(active[t])
        before = h[:, :m]
        a = table.take(x[t, :m], axis=1)
        u = rec @ before
        zr = a[: 2 * hidden]
        zr += u[: 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5  # the logistic function
        z, r = zr[:hidden], zr[hidden:]
        v = u[2 * hidden :]
        v += bias
        n = a[2 * hidden :]
        if keep is None:
            v *= r
            n += v
        else:
            n += r * v
        np.tanh(n, out=n)
        after = before - n
        after *= z
        after += n
        if keep is not None:
            keep.append((before, z, r, v, n))
        h = after
        np.matmul(out_w, after, out=out[t, :, :m])
    return out


def _back(w: dict, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grads: dict) -> None:
    """Gradients from those of _run's result."""
    hidden = w[f"c{d}"].shape[0]
    rec, out_w = w[f"h{d}"], w[f"o{d}"]
    drec, dc, do = np.zeros_like(rec), np.zeros_like(w[f"c{d}"]), np.zeros_like(out_w)
    dtable, read = [], []
    carry = np.zeros((hidden, 0), np.float32)
    for t in range(len(x) - 1, -1, -1):
        before, z, r, v, n = kept[t]
        m = before.shape[1]
        if carry.shape[1] < m:
            carry = np.concatenate([carry, np.zeros((hidden, m - carry.shape[1]), np.float32)], axis=1)
        g = dout[t, :, :m]
        do += g @ (n + z * (before - n)).T
        dh = out_w.T @ g + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * v * r * (1 - r)
        dv = dn * r
        du = np.concatenate([dz, dr, dv])
        dtable.append(np.concatenate([dz, dr, dn]))
        read.append(x[t, :m])
        drec += du @ before.T
        dc += dv.sum(axis=1, keepdims=True)
        carry = dh * z + rec.T @ du
    every, byte = np.concatenate(dtable, axis=1), np.concatenate(read)
    order = np.argsort(byte, kind="stable")
    firsts = np.flatnonzero(np.append(True, byte[order][1:] != byte[order][:-1]))
    dx = np.zeros_like(w[f"x{d}"])
    dx[:, byte[order][firsts]] = np.add.reduceat(every[:, order], firsts, axis=1)
    grads[f"x{d}"], grads[f"h{d}"], grads[f"c{d}"], grads[f"o{d}"] = dx, drec, dc, do


def _turned(sizes: np.ndarray, steps: int) -> np.ndarray:
    """Places (T, B) that read each column from its end; those beyond its size do not matter."""
    return np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)


def _labels(w: dict, x: np.ndarray, sizes: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
    """Probabilities (T, L, B) at each byte of the columns."""
    back = _turned(sizes, len(x))
    out = _run(w, "f", x, sizes, keep[0] if keep else None)
    behind = _run(w, "b", np.take_along_axis(x, back, 0), sizes, keep[1] if keep else None)
    full = int(np.searchsorted(-sizes, -len(x), "right"))  # columns of full length are simply turned round
    out[:, :, :full] += behind[::-1, :, :full]
    if full < x.shape[1]:
        out[:, :, full:] += np.take_along_axis(behind[:, :, full:], back[:, None, full:], 0)
    out += w["bias"]
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def _grid(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (T, B) of windows, longest first; their sizes; and the order."""
    sizes = np.array([len(s) for s in windows])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((len(windows), int(sizes.max())), np.uint8)
    for row, i in zip(grid, order):
        row[: sizes[i]] = np.frombuffer(windows[i], np.uint8)
    return np.ascontiguousarray(grid.T), sizes[order], order


def gradients(model: Model, windows: list[bytes], target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all bytes, and its gradients."""
    w = model.weights
    x, sizes, order = _grid(windows)
    kept: tuple[list, list] = ([], [])
    p = _labels(w, x, sizes, kept)
    on = (np.arange(len(x))[:, None] < sizes).astype(np.float32)
    own = target[order]
    columns = np.arange(len(windows))
    loss = float(-(np.log(p[:, own, columns] + 1e-30) * on).sum() / on.sum())
    p[:, own, columns] -= 1
    p *= (on / on.sum())[:, None, :]
    grads = {"bias": p.sum(axis=(0, 2))[:, None]}
    back = _turned(sizes, len(x))
    _back(w, "f", x, kept[0], p, grads)
    _back(w, "b", np.take_along_axis(x, back, 0), kept[1], np.take_along_axis(p, back[:, None, :], 0), grads)
    return loss, grads


def train(windows: dict[str, list[bytes]], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of the languages in ``windows``; every byte of a window is labelled with its language."""
    languages = sorted(windows)
    model = Model.fresh(languages, seed=seed)
    rng = np.random.default_rng(seed)
    pairs = [(s, i) for i, lang in enumerate(languages) for s in windows[lang] if s]
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(pairs) // BATCH)
    for _ in range(epochs):
        rng.shuffle(pairs)
        for at in range(0, len(pairs), BATCH):
            some = pairs[at : at + BATCH]
            _, grads = gradients(model, [s for s, _ in some], np.array([i for _, i in some]))
            step += 1
            rate = RATE * (1.05 - step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = (model.weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def _window_sums(w: dict, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each window the sums (B, L) of the probabilities at its bytes that may belong to a letter."""
    sums = np.zeros((len(starts), len(w["bias"])))
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), COLUMNS):
        some = order[at : at + COLUMNS]
        steps = np.arange(int(sizes[some[0]]))[:, None]
        x = data[np.minimum(starts[some] + steps, len(data) - 1)]
        counts = _MAYBE[x] & (steps < sizes[some])
        p = _labels(w, x, sizes[some])
        p *= counts[:, None, :]
        sums[some] = p.sum(axis=0).T
    return sums


class Reader:
    """Predictions for whole texts."""

    def __init__(self, model: Model):
        self.model = model

    def _slice(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of probabilities and number of counted bytes of each text, and whether it has a letter."""
        data, bounds = raw(arr)
        before = lambda flags: np.append(0, np.cumsum(flags))
        letters, maybe = before(_LETTER[data]), before(_MAYBE[data])
        lettered = letters[bounds[1:]] > letters[bounds[:-1]]
        counted = maybe[bounds[1:]] - maybe[bounds[:-1]]
        for i in np.flatnonzero(~lettered & (counted > 0)):
            lettered[i] = any(c.isalpha() for c in arr[int(i)].as_py() or "")
        # Nothing is read of texts without a letter.
        size = np.where(lettered, np.diff(bounds), 0)
        many = -(-size // WINDOW)
        text = np.repeat(np.arange(len(arr)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        starts = bounds[:-1][text] + nth * WINDOW
        sums = np.zeros((len(arr), len(self.model.languages)))
        if len(text):
            per = _window_sums(self.model.weights, data, starts, np.minimum(bounds[1:][text] - starts, WINDOW))
            for j in range(sums.shape[1]):
                sums[:, j] = np.bincount(text, per[:, j], len(arr))
        return sums, counted, lettered

    def predict(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores = np.zeros(len(arr))
        if not self.model.languages:
            return [UNKNOWN] * len(arr), scores
        for at, part in slices(arr):
            sums, counted, lettered = self._slice(part)
            best = sums.argmax(axis=1)
            known = lettered & (counted > 0)
            langs += [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            share = sums[np.arange(len(part)), best] / np.maximum(counted, 1)
            scores[at : at + len(part)] = np.where(known, np.clip(share, 0, 1), 0)
        return langs, scores


def reader(model: Model) -> Reader:
    """The worker's reader of this model; kept between tasks."""
    key = zlib.crc32(b"".join(model.weights[k].tobytes() for k in sorted(model.weights)) + repr(model.languages).encode())
    return held(("langid", key), lambda: Reader(model))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, stretch): SAMPLE_WINDOWS stretches of each text that has a letter, evenly spread over it."""
    for batch in batches:
        langs, parts = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode()
            if not _MAYBE[np.frombuffer(data, np.uint8)].any():
                continue
            n = min(SAMPLE_WINDOWS, -(-len(data) // TRAIN_WINDOW))
            for k in range(n):
                at = k * max(0, len(data) - TRAIN_WINDOW) // max(1, n - 1)
                langs.append(lang)
                parts.append(data[at : at + TRAIN_WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])


def _bucket(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from text and lang of the rows whose crc32(doc_id) mod 4 is not 2."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(_bucket() != 2)
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    many = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in many.collect()}
    if not counts:
        return Model.fresh([])
    # A bound of the hash under which about twice the sample lies is a literal for each language: one scan
    # draws all languages, and few rows are ranked.
    share = F.lit(0.0)
    for lang in sorted(counts):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * sample_docs + 100) / counts[lang]))).otherwise(share)
    near = labelled.where(F.shiftrightunsigned("h", 33) < share * (1 << 31))
    drawn = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample_docs)
    rows = drawn.select("lang", "text").mapInArrow(tidy(_stretches), "lang string, part binary").toArrow()
    windows: dict[str, list[bytes]] = {}
    for lang, part in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        windows.setdefault(lang, []).append(part)
    return train({lang: sorted(some) for lang, some in windows.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input with the predicted language and its pooled probability; nothing is shuffled."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores = reader(model).predict(texts)
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])

    found = fresh_name(docs, "found")
    return docs.withColumn(found, of(F.col(text).cast("string"))).withColumn(lang, F.col(found)["lang"]).withColumn(score, F.col(found)["score"]).drop(found)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(_bucket(doc_id) == 2, F.lit(False))
