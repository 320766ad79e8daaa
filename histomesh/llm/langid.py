"""Language of a document by a bidirectional gated recurrent network over its bytes.

The network is trained in numpy by backpropagation through time on a bounded sample and
labels every byte position with language probabilities; a document's probabilities are the
mean over all its positions. Texts are read whole, in windows of ``WINDOW`` bytes in which
both directions start anew, so that windows of many documents advance side by side.
Gates and candidate use x / (1 + |x|) as their squashing function, in training and use alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.llm.words import pieces, utf8

WINDOW, SIDE_BY_SIDE = 128, 1024
UNDETERMINED = "und"


@dataclass
class Network:
    """Languages, and for each direction input table, recurrent weights and output weights."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.recurrent[0].shape[0]


def fresh(languages: list[str], hidden: int, seed: int) -> Network:
    random = np.random.default_rng(seed)
    make = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        languages,
        [make(256, 3 * hidden, scale=0.5) for _ in range(2)],
        [make(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
        [make(hidden, len(languages), scale=hidden**-0.5) for _ in range(2)],
        np.zeros(len(languages), np.float32),
    )


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(x)) ** 2


def _forward(table: np.ndarray, recurrent: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of ``codes`` (steps, batch), and what the way back needs."""
    hidden = recurrent.shape[0]
    h = np.zeros((codes.shape[1], hidden), np.float32)
    states, kept = np.empty((*codes.shape, hidden), np.float32), []
    for t, step in enumerate(codes):
        inputs, from_h = table[step], h @ recurrent
        gates = inputs[:, : 2 * hidden] + from_h[:, : 2 * hidden]
        z, r = np.split(0.5 + 0.5 * _squash(gates), 2, 1)
        own = from_h[:, 2 * hidden :]
        before = inputs[:, 2 * hidden :] + r * own
        n = _squash(before)
        kept.append((h, gates, z, r, own, before, n))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(recurrent: np.ndarray, kept: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs at each step and of the recurrent weights."""
    hidden = recurrent.shape[0]
    d_inputs = np.empty((*slopes.shape[:2], 3 * hidden), np.float32)
    d_recurrent, d_h = np.zeros_like(recurrent), np.zeros_like(slopes[0])
    for t in reversed(range(len(kept))):
        h, gates, z, r, own, before, n = kept[t]
        d = slopes[t] + d_h
        d_before = d * (1 - z) * _slope(before)
        d_gates = np.concatenate([d * (h - n), d_before * own], 1) * 0.5 * _slope(gates)
        d_from_h = np.concatenate([d_gates, d_before * r], 1)
        d_inputs[t, :, : 2 * hidden], d_inputs[t, :, 2 * hidden :] = d_gates, d_before
        d_recurrent += h.T @ d_from_h
        d_h = d * z + d_from_h @ recurrent.T
    return d_inputs, d_recurrent


def train(samples: list[tuple[bytes, str]], hidden: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Network:
    """A network fitted to byte windows with their languages; the same for the same samples.

    Every position is to carry its window's language. A few bytes are replaced at random, so
    that no single byte decides.
    """
    languages = sorted({language for _, language in samples})
    net, random = fresh(languages, hidden, seed), np.random.default_rng(seed)
    codes = np.zeros((len(samples), WINDOW), np.uint8)
    real = np.zeros((len(samples), WINDOW), np.float32)
    for k, (window, _) in enumerate(samples):
        codes[k, : len(window)] = np.frombuffer(window, np.uint8)
        real[k, : len(window)] = 1
    labels = np.array([languages.index(language) for _, language in samples])
    weights = [*net.tables, *net.recurrent, *net.outputs, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(samples))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            x = codes[some].T.copy()
            noise = random.random(x.shape) < 0.03
            x[noise] = random.integers(32, 256, int(noise.sum()))
            mask = real[some].T
            ways = [x, x[::-1]]
            passed = [_forward(net.tables[k], net.recurrent[k], ways[k]) for k in range(2)]
            forth, back = passed[0][0], passed[1][0][::-1]
            scores = forth @ net.outputs[0] + back @ net.outputs[1] + net.bias
            p = np.exp(scores - scores.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(some)), labels[some]] -= 1
            d = (p * mask[:, :, None] / max(mask.sum(), 1)).astype(np.float32)
            d_tables, d_recurrent = [], []
            for k, slopes in enumerate((d @ net.outputs[0].T, (d @ net.outputs[1].T)[::-1])):
                d_inputs, d_own = _backward(net.recurrent[k], passed[k][1], slopes)
                flat, at = d_inputs.reshape(-1, d_inputs.shape[2]), ways[k].reshape(-1)
                d_tables.append(np.stack([np.bincount(at, flat[:, j], 256) for j in range(flat.shape[1])], 1).astype(np.float32))
                d_recurrent.append(d_own)
            flat_d = d.reshape(-1, d.shape[2])
            d_outputs = [forth.reshape(-1, hidden).T @ flat_d, back.reshape(-1, hidden).T @ flat_d]
            step += 1
            pace = rate * (1 - (epoch * len(order) + low) / (epochs * len(order))) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for w, g, m, v in zip(weights, [*d_tables, *d_recurrent, *d_outputs, flat_d.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * m / (np.sqrt(v) + 1e-8)
    return net


class Reader:
    """A network laid out for reading many windows at once: units by windows."""

    def __init__(self, net: Network):
        h = net.hidden
        self.hidden, self.classes = h, len(net.languages)
        self.tables = [np.ascontiguousarray(t.T) for t in net.tables]
        self.recurrent = [np.ascontiguousarray(u.T) for u in net.recurrent]
        self.outputs = [np.ascontiguousarray(o.T) for o in net.outputs]
        self.bias = net.bias[:, None]

    def _run(self, k: int, codes: np.ndarray, mask: np.ndarray | None):
        """The state after each step, newest array reused."""
        h, n = self.hidden, codes.shape[1]
        state = np.zeros((h, n), np.float32)
        from_h, size = np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        for t, step in enumerate(codes):
            inputs = self.tables[k].take(step, axis=1)
            np.matmul(self.recurrent[k], state, out=from_h)
            gates = inputs[: 2 * h]
            gates += from_h[: 2 * h]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            own, new = from_h[2 * h :], inputs[2 * h :]
            own *= gates[h:]
            new += own
            np.abs(new, out=own)
            own += 1
            new /= own
            state -= new
            state *= gates[:h]
            state += new
            if mask is not None:
                state *= mask[t]
            yield state

    def sums(self, codes: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Language probabilities summed over the positions of windows (steps, windows)."""
        steps, n = codes.shape
        forth = np.empty((steps, self.classes, n), np.float32)
        for t, state in enumerate(self._run(0, codes, mask)):
            np.matmul(self.outputs[0], state, out=forth[t])
        total = np.zeros((self.classes, n), np.float32)
        back = self._run(1, codes[::-1], None if mask is None else mask[::-1])
        for t, state in zip(reversed(range(steps)), back, strict=True):
            p = forth[t]
            p += self.outputs[1] @ state
            p += self.bias
            np.minimum(p, 60, out=p)
            np.exp(p, out=p)
            p /= p.sum(0)
            if mask is not None:
                p *= mask[t]
            total += p
        return total


def document_probabilities(reader: Reader, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all byte positions of each row; zeros for empty rows."""
    sizes = np.diff(offsets)
    full, over = sizes // WINDOW, sizes % WINDOW
    rows = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
    total = np.zeros((len(sizes), reader.classes))
    for low in range(0, len(rows), SIDE_BY_SIDE):
        own = slice(low, low + SIDE_BY_SIDE)
        starts = offsets[rows[own]] + nth[own] * WINDOW
        codes = data[starts[None, :] + np.arange(WINDOW)[:, None]]
        np.add.at(total, rows[own], reader.sums(codes).T)
    ends = np.flatnonzero(over)
    ends = ends[np.argsort(over[ends], kind="stable")]
    for low in range(0, len(ends), SIDE_BY_SIDE):
        own = ends[low : low + SIDE_BY_SIDE]
        steps = np.arange(over[own].max())[:, None]
        at = (offsets[own] + full[own] * WINDOW)[None, :] + steps
        mask = (steps < over[own][None, :]).astype(np.float32)
        codes = data[np.minimum(at, max(len(data) - 1, 0))]
        np.add.at(total, own, reader.sums(codes, mask).T)
    return total / np.maximum(sizes, 1)[:, None]


def _read(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net.languages else None
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            found, scores = [], []
            for row, to in pieces(offsets):
                own = offsets[row : to + 1]
                if reader is None:
                    best, score = np.zeros(to - row, int), np.zeros(to - row)
                else:
                    p = document_probabilities(reader, data[own[0] : own[-1]], own - own[0])
                    best, score = p.argmax(1), np.clip(p.max(1), 0, 1)
                known = letters[row:to] & (reader is not None)
                found += [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                scores += np.where(known, score, 0.0).tolist()
            kept = batch.drop_columns(["_text", "_letters"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*kept.schema.names, "lang_pred", "score"]
            )

    return run


def samples(docs: DataFrame, text: str, lang: str, order: str, per_language: int, windows: int) -> list[tuple[bytes, str]]:
    """Up to ``windows`` windows from each of ``per_language`` documents of every language.

    Documents in order of the hash of ``order``; windows spread over the whole text.
    """
    value = F.col(f"`{text}`")
    span = F.greatest(F.length(value) - WINDOW, F.lit(0))
    starts = [F.floor(span * k / max(windows - 1, 1)).cast("int") + 1 for k in range(windows)]
    cuts = F.array_distinct(F.array(*[F.substring(value, s, F.lit(WINDOW)) for s in starts]))
    rows = docs.filter(F.col(f"`{lang}`").isNotNull() & value.rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{order}`")).alias("h"), F.xxhash64(value).alias("tie"), cuts.alias("cuts"))
    first = Window.partitionBy("lang").orderBy("h", "tie")
    rows = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_language)
    found = rows.select("lang", "h", F.posexplode("cuts").alias("at", "window")).orderBy("lang", "h", "at", "window").collect()
    return [(r["window"].encode()[:WINDOW], r["lang"]) for r in found]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", per_language: int = 300, windows: int = 4) -> Network:
    """A network for the languages found in ``docs``, which must hold training rows only.

    At most ``per_language`` documents a language and ``windows`` windows a document are
    gathered, whatever the size of the corpus. Rows without language or letters are left out;
    without any rows the network knows no language.
    """
    found = samples(docs, text, lang, order, per_language, windows)
    return train(found) if found else Network([], [], [], [], np.zeros(0, np.float32))


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if the
    network knows no language. Ties go to the language first in order. Input columns of the
    two result names are replaced. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    inner = [f"c{k}" for k in range(len(kept))]
    rows = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(i) for c, i in zip(kept, inner, strict=True)], value.alias("_text"), value.rlike(r"\p{L}").alias("_letters"))
    shape = ", ".join([f"{i} {rows.schema[i].dataType.simpleString()}" for i in inner] + ["lang_pred string", "score double"])
    return rows.mapInArrow(_read(net), shape).toDF(*kept, "lang_pred", "score")
