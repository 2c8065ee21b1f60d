"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Each position of a text gets a distribution over the learned languages from a forward and a backward
network; a document's distribution is the mean over all its positions. Texts run in windows of
``window`` bytes, each read from both sides; windows of many texts run side by side in numpy. States start
anew in each window, so a position sees the bytes of its own window.

The network is trained on the driver by backpropagation through time, from a bounded sample: at most
``per_language`` snippets of ``snippet`` characters for each language, and about ``total`` in all, picked by the
hash of the text over all labelled rows. Every language with a labelled text is learned; every text is
then predicted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.textops import byte_slices, text_column

_PAD = 256
_SALTS = 64


@dataclass(frozen=True)
class LanguageOptions:
    """Bounds of the training sample, sizes of the network and of its training."""

    per_language: int = 600
    total: int = 60_000
    snippet: int = 240
    hidden: int = 8
    window: int = 48
    batch: int = 256
    steps: int = 220
    rate: float = 0.02
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text is 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def training_sample(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> list[tuple[str, str]]:
    """Bounded sample of (snippet, lang) from rows that are not held out; copies of a text count once.

    The snippets of the smallest text hashes are taken, first per language and salt, then per language, so that no
    task ranks all texts of a frequent language. Every language gets a snippet, even where there are over ``total``.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.select("lang").distinct().count()
    share = max(1, min(options.per_language, options.total // max(langs, 1)))
    mark = F.xxhash64("text")
    start = F.pmod(mark, F.greatest(F.length("text") - options.snippet, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", mark.alias("mark"), F.substring(F.col("text"), start, F.lit(options.snippet)).alias("snippet"))
    rows = rows.groupBy("lang", "mark").agg(F.min("snippet").alias("snippet")).withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(_SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("mark", "snippet"))
        rows = rows.withColumn("place", place).where(F.col("place") <= share)
    return [(r.snippet, r.lang) for r in rows.orderBy("lang", "place").select("snippet", "lang").collect()]


def _windows(data: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (window, n) of all windows, padded; which are real; and each window's text."""
    length = np.diff(start)
    n = -(-length // window)
    text = np.repeat(np.arange(len(length)), n)
    first = start[text] + window * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    at = first + np.arange(window)[:, None]
    real = at < start[text + 1]
    symbols = np.where(real, data[np.minimum(at, max(len(data) - 1, 0))], _PAD) if len(data) else np.zeros((window, 0), np.int64)
    return symbols.astype(np.int64), real.astype(np.float32), text


class ByteNetwork:
    """Weights of both directions: symbol tables (3H, 257), recurrent (3H, H), output (L, H), bias (L, 1)."""

    def __init__(self, langs: list[str], options: LanguageOptions):
        rng = np.random.default_rng(options.seed)
        h, n = options.hidden, len(langs)
        self.langs, self.options = langs, options
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("table", draw(3 * h, _PAD + 1, scale=0.3)), ("recur", draw(3 * h, h, scale=h**-0.5)), ("out", draw(n, h, scale=0.3)))}
        self.w["bias"] = np.zeros((n, 1), np.float32)

    def _run(self, d: str, symbols: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (window, H, n) of one direction; ``keep`` collects what backpropagation needs."""
        h, table, recur = self.options.hidden, self.w["table" + d], self.w["recur" + d]
        steps = range(len(symbols)) if d == "f" else range(len(symbols) - 1, -1, -1)
        out = np.empty((len(symbols), h, symbols.shape[1]), np.float32)
        state = np.zeros((h, symbols.shape[1]), np.float32)
        for t in steps:
            x = table.take(symbols[t], axis=1)
            g = recur @ state
            gates = x[: 2 * h] + g[: 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:h], gates[h:]
            n = np.tanh(x[2 * h :] + r * g[2 * h :])
            new = n + z * (state - n)
            if d == "b":
                new *= real[t]
            if keep is not None:
                keep.append((t, state, z, r, n, g[2 * h :]))
            state = out[t] = new
        return out

    def _softmax(self, states: dict[str, np.ndarray], t: int) -> np.ndarray:
        logits = self.w["outf"] @ states["f"][t] + self.w["outb"] @ states["b"][t] + self.w["bias"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=0)

    def window_sums(self, symbols: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Per window, the sum over its positions of the label distribution (n, L)."""
        states = {d: self._run(d, symbols, real) for d in "fb"}
        total = np.zeros((len(self.langs), symbols.shape[1]), np.float64)
        for t in range(len(symbols)):
            total += self._softmax(states, t) * real[t]
        return total.T

    def gradients(self, symbols: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all real positions and its gradients, by backpropagation through time."""
        h, grads = self.options.hidden, {k: np.zeros_like(v) for k, v in self.w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(d, symbols, real, kept[d]) for d in "fb"}
        columns, weight, loss = np.arange(symbols.shape[1]), 1 / max(real.sum(), 1), 0.0
        back = {d: np.empty_like(states[d]) for d in "fb"}
        for t in range(len(symbols)):
            p = self._softmax(states, t)
            loss -= float((np.log(p[label, columns] + 1e-12) * real[t]).sum()) * weight
            p[label, columns] -= 1
            p *= real[t] * weight
            grads["bias"] += p.sum(axis=1, keepdims=True)
            for d in "fb":
                grads["out" + d] += p @ states[d][t].T
                back[d][t] = self.w["out" + d].T @ p
        for d in "fb":
            recur, carry = self.w["recur" + d], np.zeros_like(states[d][0])
            inputs = np.empty((len(symbols), 3 * h, symbols.shape[1]), np.float32)
            for t, before, z, r, n, g in reversed(kept[d]):
                dh = back[d][t] + carry
                if d == "b":
                    dh = dh * real[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                through = np.concatenate([dz, dr, dn * r])
                grads["recur" + d] += through @ before.T
                carry = dh * z + recur.T @ through
                inputs[t] = np.concatenate([dz, dr, dn])
            flat = symbols.ravel()
            for i in range(3 * h):
                grads["table" + d][i] = np.bincount(flat, inputs[:, i].ravel(), _PAD + 1)
        return loss, grads

    def train(self, sample: list[tuple[str, str]]) -> list[float]:
        """Adam over batches with equal shares of all languages; the losses."""
        options = self.options
        if not sample:
            return []
        number = {x: i for i, x in enumerate(self.langs)}
        raw = [s.encode() for s, _ in sample]
        start = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        symbols, real, text = _windows(np.frombuffer(b"".join(raw), np.uint8), start, options.window)
        label = np.array([number[x] for _, x in sample])[text]
        if not len(text):
            return []
        groups = [g for g in (np.flatnonzero(label == i) for i in range(len(self.langs))) if len(g)]
        rng, losses = np.random.default_rng(options.seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in "mv")
        for step in range(options.steps):
            pick = np.concatenate([g[rng.integers(0, len(g), max(1, options.batch // len(groups)))] for g in groups])
            loss, grads = self.gradients(symbols[:, pick], real[:, pick], label[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = options.rate * (1 - step / options.steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-8)
        return losses

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Mean label distribution of each whole text (n, L); zeros for texts without bytes."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        start = offsets - offsets[0]
        symbols, real, text = _windows(data, start, self.options.window)
        total = np.zeros((n, len(self.langs)))
        for lo in range(0, len(text), 2048):
            np.add.at(total, text[lo : lo + 2048], self.window_sums(symbols[:, lo : lo + 2048], real[:, lo : lo + 2048]))
        return total / np.maximum(np.diff(start), 1)[:, None]


def train_network(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> ByteNetwork:
    sample = training_sample(docs, options)
    network = ByteNetwork(sorted({x for _, x in sample}), options)
    network.train(sample)
    return network


def language_struct(docs: DataFrame, options: LanguageOptions = LanguageOptions()):
    """Trains on ``docs``; a function from a text column to struct(lang_pred, score)."""
    network = docs.sparkSession.sparkContext.broadcast(train_network(docs, options))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        own = network.value
        texts = text_column(column)
        langs, scores = [], []
        for lo, hi in byte_slices(texts):
            part = texts.slice(lo, hi - lo)
            chances = own.predict(part) if own.langs else None
            for i, text in enumerate(part.to_pylist()):
                if chances is None or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    best = int(chances[i].argmax())
                    langs.append(own.langs[best])
                    scores.append(float(min(1.0, chances[i, best])))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without letters are ``und`` with score 0; so are all texts when no labelled row
    can be learned from. Ties go to the language that sorts first. Each row is predicted from its own text
    alone, so repeated rows agree; a null doc_id counts as held out. Columns other than doc_id, text and lang are not
    read, lang only for learning. An empty table gives no rows. A text runs in slices of its windows, so its
    length is bounded only by one task's memory for its bytes.
    """
    predict = language_struct(docs, options)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")


def filter_language(docs: DataFrame, min_score: float = 0.3, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """Rows of ``docs`` whose language is recognised with at least ``min_score``; columns as they came, whatever their names.

    Null texts and texts without letters go, and every row where no labelled row can be learned from. Repeated
    rows stay or go together; an empty table stays empty.
    """
    predict = language_struct(docs, options)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict("text").alias("p"))
    return judged.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= min_score)).select("row.*")
