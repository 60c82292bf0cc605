"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads runs of non-space bytes in both directions, labels every byte position with a probability per
language, and a document pools the mean log probability of all its positions. It is trained in numpy by
backpropagation through time on a bounded sample of labelled documents. State starts anew at white space, so
the labels of a run depend on its bytes alone: equal runs are labelled once and remembered, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import col, hash_sample
from .text import Words, buffers, pieces, split_words

UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdConfig:
    """The model is fitted on at most ``docs_per_language`` distinct labelled texts of each of the ``most_languages``
    most frequent languages. Of each text it sees ``sample_chars`` characters from a place chosen by the
    text's hash. Prediction reads whole texts. A worker labels and remembers as many runs at a time as keep its arrays
    near ``work_values`` numbers, for any number of languages."""

    hidden: int = 16
    run_bytes: int = 32
    docs_per_language: int = 300
    most_languages: int = 200
    sample_chars: int = 1500
    steps: int = 220
    batch: int = 512
    rate: float = 0.02
    seed: int = 7
    remembered_runs: int = 200_000
    work_values: int = 1 << 20


def runs(words: Words, limit: int) -> Words:
    """Words cut into consecutive runs of at most ``limit`` bytes."""
    n = -(-(words.end - words.start) // limit)
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = words.start[which] + nth * limit
    return Words(words.data, words.offsets, start, np.minimum(start + limit, words.end[which]), words.row[which])


def padded(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of each run by (place, run), zero beyond its end."""
    place = np.arange(int(length.max(initial=1)))[:, None]
    at = np.minimum(start + place, max(len(data) - 1, 0))
    return np.where(place < length, data[at], 0).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """Gated recurrent units in one direction; the input weights of a byte are a row of ``table``."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        wide = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.table, self.gates, self.candidate = wide(256, 3 * hidden), wide(hidden, 2 * hidden), wide(hidden, hidden)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.candidate]

    def forward(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        size = self.candidate.shape[0]
        h = np.zeros((x.shape[1], size), self.table.dtype)
        states = np.empty((*x.shape, size), self.table.dtype)
        for t in range(len(x)):
            into = self.table[x[t]]
            zr = _sigmoid(into[:, : 2 * size] + h @ self.gates)
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(into[:, 2 * size :] + (r * h) @ self.candidate)
            if tape is not None:
                tape.append((h, z, r, n))
            h = n + z * (h - n)
            states[t] = h
        return states

    def backward(self, x: np.ndarray, tape: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, back through time. Places beyond a run's end have no gradient."""
        d_table, d_gates, d_candidate = (np.zeros_like(p) for p in self.parameters())
        d_into = np.empty((*x.shape, self.table.shape[1]), self.table.dtype)
        dh = np.zeros_like(d_states[0])
        for t in reversed(range(len(x))):
            h, z, r, n = tape[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            d_rh = dn @ self.candidate.T
            d_candidate += (r * h).T @ dn
            d_zr = np.concatenate([dh * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_gates += h.T @ d_zr
            dh = dh * z + d_rh * r + d_zr @ self.gates.T
            d_into[t] = np.concatenate([d_zr, dn], axis=1)
        np.add.at(d_table, x.ravel(), d_into.reshape(-1, d_into.shape[2]))
        return [d_table, d_gates, d_candidate]


class Network:
    """Two directions and one softmax per byte position."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.out = (rng.standard_normal((2 * hidden, len(labels))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.out, self.bias]

    @staticmethod
    def _mirrored(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each run in reverse, its last byte first; what lies beyond the end stays beyond it."""
        place = np.arange(len(x))[:, None]
        return np.take_along_axis(x, np.where(place < length, length - 1 - place, place).reshape(len(x), -1, *[1] * (x.ndim - 2)), 0)

    def log_probabilities(self, x: np.ndarray, length: np.ndarray, tapes: tuple | None = None):
        """Log probabilities (place, run, label), and the states they came from."""
        ahead = self.ahead.forward(x, tapes and tapes[0])
        back = self._mirrored(self.back.forward(self._mirrored(x, length), tapes and tapes[1]), length)
        states = np.concatenate([ahead, back], axis=2)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), states

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient for every parameter."""
        tapes = ([], [])
        logp, states = self.log_probabilities(x, length, tapes)
        weight = (np.arange(len(x))[:, None] < length) / length.sum()
        loss = -float((logp[:, np.arange(len(label)), label] * weight).sum())
        d = np.exp(logp)
        d[:, np.arange(len(label)), label] -= 1
        d = (d * weight[:, :, None]).astype(states.dtype)
        size = self.ahead.candidate.shape[0]
        d_states = d @ self.out.T
        d_back = self._mirrored(d_states[:, :, size:], length)
        return loss, [
            *self.ahead.backward(x, tapes[0], d_states[:, :, :size]),
            *self.back.backward(self._mirrored(x, length), tapes[1], d_back),
            np.einsum("tbh,tbc->hc", states, d),
            d.sum(axis=(0, 1)),
        ]

    def pooled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, work: int = 1 << 20) -> np.ndarray:
        """Summed log probabilities over the positions of each run, for runs whose arrays hold about ``work`` numbers."""
        wide = int(length.max(initial=1)) * (len(self.labels) + 2 * self.ahead.candidate.shape[0])
        chunk = max(16, work // wide)
        total = np.zeros((len(start), len(self.labels)), np.float32)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), chunk):
            some = order[at : at + chunk]
            x = padded(data, start[some], length[some])
            logp, _ = self.log_probabilities(x, length[some])
            total[some] = np.where((np.arange(len(x))[:, None] < length[some])[:, :, None], logp, 0).sum(axis=0)
        return total


def train(texts: list[str], labels: list[str], cfg: LangIdConfig) -> Network | None:
    """Fit on the runs of the sampled texts, every language with the same weight. None without any run."""
    split = runs(split_words(*buffers(pa.array(texts, pa.string()))), cfg.run_bytes)
    if not len(split.start):
        return None
    names = sorted(set(labels))
    of_run = np.array([names.index(x) for x in labels])[split.row]
    pools = [p for p in (np.flatnonzero(of_run == k) for k in range(len(names))) if len(p)]
    net, rng = Network(names, cfg.hidden, cfg.seed), np.random.default_rng(cfg.seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    length = split.end - split.start
    for step in range(1, cfg.steps + 1):
        some = np.concatenate([rng.choice(p, cfg.batch // len(pools) + 1) for p in pools])
        _, grads = net.gradients(padded(split.data, split.start[some], length[some]), length[some], of_run[some])
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
        rate = cfg.rate * (1 - step / (cfg.steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g * scale - m)
            v += 0.001 * ((g * scale) ** 2 - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)
    return net


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", cfg: LangIdConfig = LangIdConfig()) -> Network | None:
    """Train on ``labelled``: rows without a language or a text are left out. None if no row remains. Copies of a
    text count once."""
    rows = labelled.select(col(labelled, lang_col).cast("string").alias("lang"), col(labelled, text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count("*").alias("rows"))
    counts = {r.lang: r.n for r in sizes.orderBy(F.desc("rows"), "lang").limit(cfg.most_languages).collect()}
    place = F.pmod(F.xxhash64("text", F.lit(cfg.seed)), F.greatest(F.length("text") - cfg.sample_chars, F.lit(0)) + 1) + 1
    rows = rows.where(F.col("lang").isin(list(counts))).withColumn("text", F.substring(F.col("text"), place, F.lit(cfg.sample_chars)))
    drawn = hash_sample(rows, "lang", counts, cfg.docs_per_language, F.col("h"), "text", once=["lang", "h"])
    sample = drawn.orderBy("lang", "h", "text").select("lang", "text").collect()
    return train([r.text for r in sample], [r.lang for r in sample], cfg)


class _Memory:
    """Pooled log probabilities of the runs seen last, by hash, in two sorted arrays."""

    def __init__(self, net: Network, cfg: LangIdConfig):
        self.net, self.work = net, cfg.work_values
        self.limit = max(1, min(cfg.remembered_runs, 2 * cfg.work_values // len(net.labels)))
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.net.labels)), np.float32)

    def of(self, some: Words) -> np.ndarray:
        keys, first, which = np.unique(some.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        values = np.empty((len(keys), len(self.net.labels)), np.float32)
        values[~new] = self.values[at[~new]]
        start = some.start[first[new]]
        values[new] = self.net.pooled(some.data, start, some.end[first[new]] - start, self.work)
        if len(self.keys) + new.sum() > self.limit:
            self.clear()
        merged = np.concatenate([self.keys, keys[new]])[: self.limit]
        order = np.argsort(merged, kind="stable")
        self.keys, self.values = merged[order], np.concatenate([self.values, values[new]])[order]
        return values[which]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    folded = data | 0x20
    ascii_letter = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for row in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[row] = any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def label_batch(texts: pa.Array, net: Network | None, memory: _Memory | None, cfg: LangIdConfig) -> pa.StructArray:
    """(lang, score) of each text of a batch, read in pieces, so that a text of any length takes the same memory."""
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if net:
        places, total = np.zeros(len(texts)), np.zeros((len(texts), len(net.labels)))
        letter = np.zeros(len(texts), bool)
        for lo, hi, data, offsets in pieces(texts, cfg.run_bytes):
            some = runs(split_words(data, offsets), cfg.run_bytes)
            places[lo:hi] += np.bincount(some.row, some.end - some.start, minlength=hi - lo)
            total[lo:hi] += np.stack([np.bincount(some.row, v, minlength=hi - lo) for v in memory.of(some).T], axis=1)
            letter[lo:hi] |= _has_letter(data, offsets)
        mean = total / np.maximum(places, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        known = np.flatnonzero(letter)
        best = p[known].argmax(axis=1)
        lang[known] = np.array(net.labels, object)[best]
        score[known] = p[known, best]
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])


def language(text: Column, net: Network | None, cfg: LangIdConfig = LangIdConfig()) -> Column:
    """struct(lang, score) of a text column. Score is the pooled probability of the language, 0 for ``und``."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = net and _Memory(net, cfg)
        for texts in batches:
            yield label_batch(texts, net, memory, cfg)
            del texts
            pa.default_memory_pool().release_unused()  # workers live on; what a long text took goes back

    return predict(text)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every row of ``docs``; no other column is read.

    ``und`` with score 0 for a text that is null or has no letter, and for all rows if there was nothing to learn
    from. Ties go to the first language by name. Repeated rows are scored alike; an empty table gives no rows.
    """
    found = docs.select(col(docs, id_col).alias("doc_id"), language(col(docs, text_col), net, cfg).alias("p"))
    return found.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
