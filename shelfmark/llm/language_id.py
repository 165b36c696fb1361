"""Language of every text, by a bidirectional gated recurrent network over its bytes.

A text is read in windows of 64 bytes, all of them, with A-Z lowered. In each,
one gated recurrent unit reads forward and one backward; at every byte the two
states together give the chances of the languages. A document's chances are the
means over all its bytes.

The network is trained in numpy by backpropagation through time, on a sample of
at most about ``SAMPLE_ROWS`` labelled rows, shared out evenly among the
languages (at most ``LANGUAGES``, the most frequent ones), and up to
``ROW_WINDOWS`` windows of each. Every position of a window is labelled with its
document's language.

Each row is read where it lies; nothing is shuffled but the sample. A task holds
one batch of texts and the states of one block of windows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if there is no labelled row; null labels are left out; languages
of equal chance go by name; rows without a doc_id are never learned from and not
held out; repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import sent_if_small
from shelfmark.llm.common import LOWER_TABLE, bounded_batches, texts, written

UNKNOWN = "und"
WINDOW = 64
UNITS = 12
SAMPLE_ROWS = 6_000
ROW_WINDOWS = 3
LANGUAGES = 256
BATCH = 128
STEPS = 900
RATE = 0.02
SEED = 7
BLOCK = 4096
HASHES = 1 << 20
# No byte of UTF-8: fills windows at the end of a text.
FILLER = 0xFF
GATES = ("update", "reset", "new")


def windows_of(text: bytes) -> np.ndarray:
    """The text's bytes, one window a row, the last one filled up."""
    text = text.translate(LOWER_TABLE)
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, bytes([FILLER])), np.uint8).reshape(n, WINDOW)


def both_ways(windows: np.ndarray) -> np.ndarray:
    """Step, direction, window: rows of the byte tables, those of the backward unit after the forward one's."""
    steps = np.empty((WINDOW, 2, len(windows)), np.intp)
    steps[:, 0] = windows.T
    steps[:, 1] = windows.T[::-1]
    steps[:, 1] += 256
    return steps


@dataclass
class Network:
    """Weights of both units and of the labels; no languages: everything is unknown."""

    languages: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def untrained(cls, languages: list[str], units: int = UNITS, seed: int = SEED) -> "Network":
        rnd = np.random.default_rng(seed)
        weights = {}
        for gate in GATES:
            weights[f"byte_{gate}"] = rnd.normal(0, 0.3, (512, units)).astype(np.float32)
            weights[f"state_{gate}"] = rnd.normal(0, units**-0.5, (2, units, units)).astype(np.float32)
        weights["label"] = rnd.normal(0, units**-0.5, (2, units, len(languages))).astype(np.float32)
        weights["bias"] = np.zeros((len(languages), 1), np.float32)
        return cls(languages, weights)

    def states(self, steps: np.ndarray) -> np.ndarray:
        """The state after each step: step, direction, window, unit."""
        w = self.weights
        # A logistic gate is (1 + tanh(x / 2)) / 2.
        tables = [w["byte_update"] / 2, w["byte_reset"] / 2, w["byte_new"]]
        update, reset, new = w["state_update"] / 2, w["state_reset"] / 2, w["state_new"]
        shape = (2, steps.shape[2], update.shape[-1])
        out = np.empty((len(steps), *shape), np.float32)
        state = np.zeros(shape, np.float32)
        gate, moved, byte = (np.empty(shape, np.float32) for _ in range(3))
        for at, rows in enumerate(steps):
            np.matmul(state, reset, out=gate)
            gate += tables[1].take(rows, axis=0, out=byte, mode="clip")
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            np.matmul(state, new, out=moved)
            moved *= gate
            moved += tables[2].take(rows, axis=0, out=byte, mode="clip")
            np.tanh(moved, out=moved)
            np.matmul(state, update, out=gate)
            gate += tables[0].take(rows, axis=0, out=byte, mode="clip")
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            # state = new + update * (state - new)
            np.subtract(state, moved, out=out[at])
            out[at] *= gate
            out[at] += moved
            state = out[at]
        return out

    def chances(self, states: np.ndarray) -> np.ndarray:
        """Language, step, window: the chance of each language at each byte."""
        n, _, windows, units = states.shape
        forward = states[:, 0].reshape(-1, units)
        backward = states[::-1, 1].reshape(-1, units)
        score = self.weights["label"][0].T @ forward.T
        score += self.weights["label"][1].T @ backward.T
        score += self.weights["bias"]
        np.clip(score, -40, 40, out=score)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        return score.reshape(-1, n, windows)

    def pooled(self, found: list[bytes]) -> np.ndarray:
        """For every text (one row), the mean chance of each language over its bytes."""
        total = np.zeros((len(found), len(self.languages)))
        cut = [windows_of(text) for text in found]
        owner = np.repeat(np.arange(len(found)), [len(one) for one in cut])
        if not len(owner):
            return total
        windows = np.concatenate(cut)
        for at in range(0, len(windows), BLOCK):
            part = windows[at : at + BLOCK]
            chance = self.chances(self.states(both_ways(part)))
            chance *= (part.T != FILLER).astype(np.float32)
            summed = chance.sum(axis=1)
            whose = owner[at : at + BLOCK]
            first = whose[0]
            for language, values in enumerate(summed):
                counts = np.bincount(whose - first, values)
                total[first : first + len(counts), language] += counts
        return total / np.maximum([[len(text)] for text in found], 1)


def slopes(network: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the bytes of the windows, and its slope for every weight, back through all steps."""
    w = network.weights
    steps = both_ways(windows)
    shape, kind = (2, len(windows), w["state_new"].shape[-1]), w["state_new"].dtype
    before = np.zeros((WINDOW + 1, *shape), kind)
    update, reset, new, inner = (np.empty((WINDOW, *shape), kind) for _ in range(4))
    for at, rows in enumerate(steps):
        state = before[at]
        update[at] = 1 / (1 + np.exp(-(w["byte_update"][rows] + state @ w["state_update"])))
        reset[at] = 1 / (1 + np.exp(-(w["byte_reset"][rows] + state @ w["state_reset"])))
        inner[at] = state @ w["state_new"]
        new[at] = np.tanh(w["byte_new"][rows] + reset[at] * inner[at])
        before[at + 1] = new[at] + update[at] * (state - new[at])
    states = before[1:]
    chance = network.chances(states)
    read = (windows.T != FILLER).astype(kind)
    n = read.sum()
    right = np.take_along_axis(chance, np.broadcast_to(labels, (1, *read.shape)), axis=0)[0]
    loss = float(-(np.log(np.maximum(right, 1e-30)) * read).sum() / n)
    by_score = chance
    by_score[labels, :, np.arange(len(labels))] -= 1
    by_score *= read / n
    flat = by_score.reshape(len(by_score), -1)
    units = shape[-1]
    found = {"bias": flat.sum(axis=1, keepdims=True)}
    forward, backward = states[:, 0].reshape(-1, units), states[::-1, 1].reshape(-1, units)
    found["label"] = np.stack([forward.T @ flat.T, backward.T @ flat.T])
    by_state = np.empty_like(states)
    by_state[:, 0] = (flat.T @ w["label"][0].T).reshape(WINDOW, -1, units)
    by_state[:, 1] = (flat.T @ w["label"][1].T).reshape(WINDOW, -1, units)[::-1]
    by_gate = {gate: np.empty_like(states) for gate in GATES}
    for gate in GATES:
        found[f"state_{gate}"] = np.zeros_like(w[f"state_{gate}"])
    later = np.zeros(shape, kind)
    turned = {gate: w[f"state_{gate}"].transpose(0, 2, 1) for gate in GATES}
    for at in range(WINDOW - 1, -1, -1):
        state = before[at].transpose(0, 2, 1)
        here = by_state[at] + later
        by_new = here * (1 - update[at]) * (1 - new[at] ** 2)
        by_update = here * (before[at] - new[at]) * update[at] * (1 - update[at])
        by_reset = by_new * inner[at] * reset[at] * (1 - reset[at])
        by_inner = by_new * reset[at]
        later = (
            here * update[at]
            + by_inner @ turned["new"]
            + by_update @ turned["update"]
            + by_reset @ turned["reset"]
        )
        by_gate["new"][at], by_gate["update"][at], by_gate["reset"][at] = by_new, by_update, by_reset
        found["state_new"] += state @ by_inner
        found["state_update"] += state @ by_update
        found["state_reset"] += state @ by_reset
    rows = steps.ravel()
    for gate in GATES:
        columns = by_gate[gate].reshape(-1, units).T
        found[f"byte_{gate}"] = np.stack([np.bincount(rows, column, 512) for column in columns], axis=1)
    return loss, found


def trained_on(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """A network fitted to labelled windows by small batches in a fixed random order."""
    network = Network.untrained(languages)
    if len(languages) < 2:
        return network
    rnd = np.random.default_rng(SEED)
    mean = {name: np.zeros_like(value) for name, value in network.weights.items()}
    square = {name: np.zeros_like(value) for name, value in network.weights.items()}
    for step in range(1, steps + 1):
        some = rnd.integers(0, len(windows), BATCH)
        _, slope = slopes(network, windows[some], labels[some])
        # Slopes through many steps can be steep: a length above 1 is cut to 1.
        length = max(1.0, float(np.sqrt(sum((one**2).sum() for one in slope.values()))))
        rate = RATE * (1 - step / (steps + 1))
        for name, value in network.weights.items():
            one = slope[name] / length
            mean[name] = 0.9 * mean[name] + 0.1 * one
            square[name] = 0.99 * square[name] + 0.01 * one**2
            move = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
            network.weights[name] = (value - rate * move).astype(np.float32)
    return network


def sample_windows(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and window of the sampled labelled rows; about as many rows of every language."""
    bounded_batches(documents.sparkSession)
    named = documents.where("doc_id is not null and lang is not null and text is not null and text <> ''")
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = written(counts, "languages")
    each = sample_rows // max(counts.count(), 1)
    shares = counts.select("lang", F.ceil(F.lit(float(each)) / F.col("n") * HASHES).alias("share"))
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(HASHES))
    some = named.join(sent_if_small(shares), "lang").where(place < F.col("share")).select("lang", "text")

    def cut(batches):
        for batch in batches:
            langs, held = [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                windows = windows_of(text)
                # Repeated rows choose the same windows.
                chosen = random.Random(zlib.crc32(text)).sample(range(len(windows)), min(ROW_WINDOWS, len(windows)))
                held += [windows[k].tobytes() for k in sorted(chosen)]
                langs += [lang] * len(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(held, pa.binary())], names=["lang", "window"])

    return some.mapInArrow(cut, "lang string, window binary")


def trained(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Network:
    """A network from the labelled rows of ``documents``."""
    rows = sorted((r["lang"], bytes(r["window"])) for r in sample_windows(documents, sample_rows).collect())
    if not rows:
        return Network()
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    windows = np.stack([np.frombuffer(window, np.uint8) for _, window in rows])
    return trained_on(windows, np.array([number[lang] for lang, _ in rows]), languages, steps)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred and score of every row, and any further columns but the text."""
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(network)
    kept = [name for name in documents.columns if name != "text"]
    known = F.when(has_letter(F.col("text")), F.col("text")).alias("text")
    source = documents.select(*kept, known)
    schema = T.StructType(
        [*(source.schema[name] for name in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def predict(batches):
        network = sent.value
        names = np.array([*network.languages, UNKNOWN], object)
        for batch in batches:
            found = texts(batch.column(len(kept)))
            if network.languages:
                chance = network.pooled(found)
                best = chance.argmax(axis=1)
                score = np.minimum(chance.max(axis=1), 1.0)
                empty = np.array([not text for text in found], bool)
                best[empty], score[empty] = len(names) - 1, 0.0
            else:
                best, score = np.zeros(len(found), np.int64), np.zeros(len(found))
            columns = [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=schema.names)

    return source.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a checksum of the id, written out, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = held_out(F.col("doc_id"))
    network = trained(documents.where(~fold))
    return predicted(documents.select("doc_id", fold.alias("held_out"), "text"), network)
