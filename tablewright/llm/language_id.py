"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes. In each window one gated recurrent layer runs
over the UTF-8 bytes from the left and one from the right; at every position the two states
together label the byte with a distribution over the languages. The distributions of all
positions of a text are averaged: that is the document's distribution, whose largest entry
gives ``lang_pred`` and ``score``. The state starts anew in each window, so windows of many
texts run side by side as one matrix and memory depends on the block of windows, not on a text.

The network is trained in numpy by backpropagation through time, on the driver, from a bounded
sample of labelled rows: ``rows`` of them, as even over the languages as these allow (those with
the smallest hashes in ``SLOTS`` slots of each language), and at least one of every language. Their whole
texts are cut into windows at character borders; if these are more than ``windows``, as many are drawn from
all of them by hash. Both bounds are arguments of ``fit``. Training goes over the windows ``EPOCHS`` times, or over
many windows as often as ``PASSES`` allow. Prediction covers every whole text; language, source and id never enter it.

Results: a text that is null or has no letter gets ``und`` and score 0, as does every text if no
labelled row is there to learn from. Repeated rows get equal results. An empty table gives an
empty one. Input columns called like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, quoted, without

WINDOW, HIDDEN = 64, 8
ROWS, WINDOWS = 800, 40_000
SLOTS = 64
EPOCHS, BATCH, RATE = 12, 128, 0.01
PASSES, LEAST_EPOCHS = 100_000, 2  # windows gone over in all
BLOCK = 2048  # windows run side by side
PAD = 256  # symbol after the end of a text
UNKNOWN = "und"


# --- network -------------------------------------------------------------------------------

def squash(x: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)`` in place, the network's bounded function. Several times cheaper than the
    hyperbolic tangent; its slope is ``(1 - |y|) ** 2`` at value y. Gates use (1 + y) / 2."""
    x /= np.abs(x) + np.float32(1)
    return x


@dataclass
class Layer:
    """A gated recurrent layer over symbols. Rows of ``table`` (symbol by 3 * hidden) hold what a
    symbol adds to update gate, reset gate and candidate; ``recurrent`` what the state adds."""

    table: np.ndarray
    recurrent: np.ndarray

    @classmethod
    def fresh(cls, dice: np.random.Generator, hidden: int) -> Layer:
        table = dice.normal(0, 0.5, (PAD + 1, 3 * hidden)).astype(np.float32)
        return cls(table, dice.normal(0, 0.4, (3 * hidden, hidden)).astype(np.float32))

    def run(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step: (steps, hidden, columns) for symbols (steps, columns)."""
        steps, n = symbols.shape
        size = self.recurrent.shape[1]
        across = np.ascontiguousarray(self.table.T)
        index = symbols.astype(np.intp)
        states = np.empty((steps, size, n), np.float32)
        state = np.zeros((size, n), np.float32)
        half = np.float32(0.5)
        for t in range(steps):
            given = np.take(across, index[t], axis=1, mode="clip")
            fed = self.recurrent @ state
            gates = given[: 2 * size]
            gates += fed[: 2 * size]
            squash(gates)
            gates *= half
            gates += half
            update, reset = gates[:size], gates[size:]
            candidate = given[2 * size :]
            candidate += reset * fed[2 * size :]
            squash(candidate)
            if keep is not None:
                keep.append((state, update, reset, candidate, fed[2 * size :]))
            np.subtract(state, candidate, out=states[t])
            states[t] *= update
            states[t] += candidate
            state = states[t]
        return states

    def back(self, symbols: np.ndarray, keep: list, push: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recurrent weights, given those of all states (``push``)."""
        recurrent = np.zeros_like(self.recurrent)
        given = np.empty((len(keep), self.table.shape[1], push.shape[2]), np.float32)
        carried = np.zeros_like(push[0])
        for t in range(len(keep) - 1, -1, -1):
            state, update, reset, candidate, fed = keep[t]
            carried = carried + push[t]
            on_candidate = carried * (1 - update) * (1 - np.abs(candidate)) ** 2
            on_update = carried * (state - candidate) * (1 - np.abs(2 * update - 1)) ** 2 / 2
            on_reset = on_candidate * fed * (1 - np.abs(2 * reset - 1)) ** 2 / 2
            to_fed = np.concatenate((on_update, on_reset, on_candidate * reset))
            recurrent += to_fed @ state.T
            given[t] = np.concatenate((on_update, on_reset, on_candidate))
            carried = carried * update + self.recurrent.T @ to_fed
        flat = symbols.ravel()
        table = [np.bincount(flat, given[:, n].ravel(), PAD + 1) for n in range(self.table.shape[1])]
        return np.array(table, np.float32).T, recurrent


@dataclass
class Network:
    """Two layers, the output weights (language by 2 * hidden) and biases, and the languages."""

    forward: Layer
    backward: Layer
    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def positions(self, symbols: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every position: (steps, languages, columns)."""
        left = self.forward.run(symbols)
        right = self.backward.run(symbols[::-1])[::-1]
        half = left.shape[1]
        logits = np.matmul(self.weights[:, :half], left) + np.matmul(self.weights[:, half:], right)
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all bytes of each text (rows)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pooled = np.zeros((len(texts), len(self.languages)))
        for symbols, owner in _windows(texts, sizes):
            real = symbols != PAD
            found = (self.positions(symbols) * real[:, None, :]).sum(axis=0, dtype=np.float64)
            np.add.at(pooled, owner, found.T)
        return pooled / np.maximum(sizes, 1)[:, None]


def _windows(texts: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of windows as (position, window) symbols, with the text each window is of. Texts
    are padded to whole windows a bounded number of bytes at a time."""
    symbols, owners, held = [], [], 0
    for n, text in enumerate(texts):
        for at in range(0, len(text), WINDOW * BLOCK):
            part = np.frombuffer(text, np.uint8, min(WINDOW * BLOCK, len(text) - at), at)
            rows = -(-len(part) // WINDOW)
            padded = np.full(rows * WINDOW, PAD, np.int16)
            padded[: len(part)] = part
            symbols.append(padded.reshape(rows, WINDOW))
            owners.append(np.full(rows, n))
            held += rows
            if held >= BLOCK:
                yield np.ascontiguousarray(np.concatenate(symbols).T), np.concatenate(owners)
                symbols, owners, held = [], [], 0
    if held:
        yield np.ascontiguousarray(np.concatenate(symbols).T), np.concatenate(owners)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit the network to windows (row each) and their language numbers, every position of a
    window being labelled with the language of its document."""
    dice = np.random.default_rng(seed)
    net = Network(
        Layer.fresh(dice, HIDDEN),
        Layer.fresh(dice, HIDDEN),
        dice.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32),
        np.zeros(len(languages), np.float32),
        languages,
    )
    held = [net.forward.table, net.forward.recurrent, net.backward.table, net.backward.recurrent, net.weights, net.bias]
    mean, spread, turn = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = dice.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            turn += 1
            for n, (param, grad) in enumerate(zip(held, _gradients(net, windows[pick].T, labels[pick]))):
                mean[n] += (grad - mean[n]) * np.float32(0.1)
                spread[n] += (grad * grad - spread[n]) * np.float32(0.01)
                step = mean[n] / (1 - 0.9**turn) / (np.sqrt(spread[n] / (1 - 0.99**turn)) + 1e-6)
                param -= (rate * step).astype(np.float32)
    return net


def _gradients(net: Network, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all positions that hold a byte."""
    keep_left, keep_right = [], []
    left = net.forward.run(symbols, keep_left)
    right = net.backward.run(symbols[::-1], keep_right)[::-1]
    both = np.concatenate((left, right), axis=1)
    logits = np.matmul(net.weights, both) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    off = np.exp(logits)
    off /= off.sum(axis=1, keepdims=True)
    off[:, labels, np.arange(len(labels))] -= 1
    real = symbols != PAD
    off *= (real / max(1, real.sum())).astype(np.float32)[:, None, :]
    on_states = np.matmul(net.weights.T, off)
    on_left, on_right = on_states[:, :HIDDEN], on_states[:, HIDDEN:]
    table_left, recurrent_left = net.forward.back(symbols, keep_left, on_left)
    table_right, recurrent_right = net.backward.back(symbols[::-1], keep_right, on_right[::-1])
    weights = np.einsum("tln,tsn->ls", off, both, optimize=True)
    return [table_left, recurrent_left, table_right, recurrent_right, weights, off.sum(axis=(0, 2))]


# --- documents -----------------------------------------------------------------------------

def held_out(id: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the id as text divisible by five (null id: not)."""
    return F.coalesce(F.crc32(quoted(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def cut(text: bytes) -> list[bytes]:
    """A text in pieces of at most ``WINDOW`` bytes that end at character borders."""
    pieces, at = [], 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(text[at:end])
        at = end
    return pieces


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([cut(value.as_py()) for value in batch], pa.list_(pa.binary()))


def labelled_windows(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, windows: int = WINDOWS
) -> DataFrame:
    """``lang, piece`` to learn from: at most ``windows`` pieces of the whole texts of ``rows`` labelled rows, or of
    one row per language where these are more."""
    every = docs.select(quoted(id).alias("id"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    every = every.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = F.xxhash64("id", "text")
    # A language is ranked in slots, so that a common one is spread over many tasks; texts stay behind.
    slotted = every.select("lang", hashed.alias("hash"), F.pmod(hashed, F.lit(SLOTS)).alias("slot"))
    first = Window.partitionBy("lang", "slot").orderBy("hash")
    ranked = slotted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= -(-rows // SLOTS))
    picked = ranked.orderBy("rank", "slot", "lang", "hash").limit(rows).select("lang", "hash")
    lone = slotted.groupBy("lang").agg(F.min("hash").alias("hash"))
    picked = picked.unionByName(lone).distinct()
    # `rows` rows and one per language, as many as the network has outputs: small, so texts are not shuffled to meet
    # them. Rows of one id and text are one row to learn from.
    sample = every.withColumn("hash", hashed).join(F.broadcast(picked), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])
    each = sample.select("lang", "hash", F.posexplode(_pieces(F.col("text").cast("binary"))).alias("n", "piece"))
    return each.orderBy(F.xxhash64("hash", "n"), "lang").limit(windows).select("lang", "piece")


def fit(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, windows: int = WINDOWS
) -> Network | None:
    """Train on the bounded sample; ``None`` if there is no labelled text."""
    sample = labelled_windows(docs, id, text, lang, rows, windows).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.lang, bytes(r.piece)))
    languages = sorted({r.lang for r in sample})
    number = {name: n for n, name in enumerate(languages)}
    symbols = np.full((len(sample), WINDOW), PAD, np.int16)
    for row, found in zip(symbols, sample):
        row[: len(found.piece)] = np.frombuffer(bytes(found.piece), np.uint8)
    epochs = int(np.clip(PASSES // len(sample), LEAST_EPOCHS, EPOCHS))
    return train(symbols, np.array([number[r.lang] for r in sample]), languages, epochs)


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    prepare(docs.sparkSession)
    rows = without(docs, ["lang_pred", "score", "_tw_found"])

    @F.arrow_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [value.encode() for value in batch.to_pylist()]
            found = net.documents(texts)
            best = found.argmax(axis=1)
            names = pa.array([net.languages[n] for n in best], pa.string())
            score = np.clip(found[np.arange(len(best)), best], 0.0, 1.0)
            yield pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], names=["lang_pred", "score"])

    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        found = unknown
    else:
        # Texts without a letter reach the worker as empty ones.
        lettered = F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False))
        found = F.when(lettered, labelled(F.when(lettered, quoted(text)).otherwise(F.lit("")))).otherwise(unknown)
    return rows.withColumn("_tw_found", found).select(*map(quoted, rows.columns), "_tw_found.lang_pred", "_tw_found.score")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict all of them: ``held_out``, ``lang_pred``
    and ``score`` beside the columns of ``docs``."""
    prepare(docs.sparkSession)
    found = predict(without(docs, ["held_out"]), fit(docs, id, text, lang), text)
    return found.withColumn("held_out", held_out(id))
