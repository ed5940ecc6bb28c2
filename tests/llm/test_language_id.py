import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, clashing, frame

from tablewright.llm import language_id as lid

VOCABULARY = {"en": "the and of that with this from have".split(), "fr": "le est dans pour où qui très déjà".split()}


def labelled(n=160, seed=5):
    dice = random.Random(seed)
    rows = []
    for doc in range(n):
        lang = dice.choice(sorted(VOCABULARY))
        rows.append((doc, " ".join(dice.choices(VOCABULARY[lang], k=dice.randint(5, 60))), lang, "a"))
    return rows


def test_gradients_equal_differences(monkeypatch):
    """Backpropagation through time against differences of the loss, in double precision."""
    dice = np.random.default_rng(3)
    net = lid.Network(lid.Layer.fresh(dice, lid.HIDDEN), lid.Layer.fresh(dice, lid.HIDDEN), dice.normal(0, 0.3, (3, 2 * lid.HIDDEN)).astype(np.float32), np.zeros(3, np.float32), list("abc"))
    symbols = dice.integers(60, 70, (7, 5)).astype(np.int16)
    symbols[5:, 2] = lid.PAD
    labels = np.array([0, 1, 2, 1, 0])

    def loss():
        found = net.positions(symbols).astype(np.float64)
        picked = np.log(found[:, labels, np.arange(5)])
        return -(picked * (symbols != lid.PAD)).sum() / (symbols != lid.PAD).sum()

    held = [net.forward.table, net.forward.recurrent, net.backward.table, net.backward.recurrent, net.weights, net.bias]
    for param, grad in zip(held, lid._gradients(net, symbols, labels)):
        big = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        for at in [big, tuple(int(dice.integers(n)) for n in grad.shape)]:
            kept, step = param[at], np.float32(2e-2)
            param[at] = kept + step
            up = loss()
            param[at] = kept - step
            down = loss()
            param[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_windows_cover_every_byte(monkeypatch):
    monkeypatch.setattr(lid, "BLOCK", 3)
    texts = [b"", b"abc", bytes(range(1, 200)) * 5, b"x" * lid.WINDOW]
    back = [b""] * len(texts)
    for symbols, owner in lid._windows(texts, np.array([len(t) for t in texts])):
        for column, n in zip(symbols.T, owner):
            back[n] += bytes(int(c) for c in column if c != lid.PAD)
    assert back == texts


def test_long_text_is_pooled_over_all_windows():
    net = lid.train(np.array([[65] * lid.WINDOW, [66] * lid.WINDOW] * 40), np.array([0, 1] * 40), ["a", "b"], epochs=60)
    mixed = net.documents([b"A" * 10000 + b"B" * 30000, b"A" * 100])
    assert mixed[0].sum() == pytest.approx(1, abs=1e-5) and mixed[0].argmax() == 1 and mixed[1].argmax() == 0
    assert 0.15 < mixed[0][0] < 0.4


def test_held_out_rows_and_accuracy(spark):
    rows = labelled()
    found = lid.identify(clashing(frame(spark, rows), ["score", "held_out", "_tw_found"])).collect()
    right = [r.lang == r.lang_pred for r in found if r.held_out]
    assert {r.doc_id for r in found if r.held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(found) == len(rows) and np.mean(right) > 0.9 and all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in labelled()]
    assert "xx" not in lid.fit(frame(spark, rows)).languages


def test_awkward_rows(spark):
    docs = frame(spark, awkward() + labelled())
    found = {(r.doc_id, r.text): r for r in lid.identify(docs).collect()}
    assert all(found[(i, t)].lang_pred == "und" for i, t, *_ in awkward() if not any(c.isalpha() for c in t or ""))
    assert all(r.lang_pred in ("en", "fr", "de") for (_, t), r in found.items() if any(c.isalpha() for c in t or ""))
    unlabelled = lid.identify(frame(spark, [(1, "some text", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    assert lid.identify(frame(spark, [], SCHEMA)).collect() == []


def plain_document(net, text):
    """Mean distribution over the bytes of a text, one number at a time."""
    squash = lambda x: x / (1 + abs(x))
    gate = lambda x: (1 + squash(x)) / 2
    size = lid.HIDDEN

    def states(layer, window):
        state, out = [0.0] * size, []
        for byte in window:
            given = [float(x) for x in layer.table[byte]]
            fed = [sum(float(w) * s for w, s in zip(row, state)) for row in layer.recurrent]
            update = [gate(given[n] + fed[n]) for n in range(size)]
            reset = [gate(given[size + n] + fed[size + n]) for n in range(size)]
            new = [squash(given[2 * size + n] + reset[n] * fed[2 * size + n]) for n in range(size)]
            state = [u * s + (1 - u) * c for u, s, c in zip(update, state, new)]
            out.append(state)
        return out

    pooled = [0.0] * len(net.languages)
    for at in range(0, len(text), lid.WINDOW):
        window = list(text[at : at + lid.WINDOW])
        window += [lid.PAD] * (lid.WINDOW - len(window))
        left, right = states(net.forward, window), states(net.backward, window[::-1])[::-1]
        for byte, a, b in zip(window, left, right):
            if byte != lid.PAD:
                logits = [sum(float(w) * x for w, x in zip(row, a + b)) + float(bias) for row, bias in zip(net.weights, net.bias)]
                weights = [2.718281828459045 ** (x - max(logits)) for x in logits]
                pooled = [p + w / sum(weights) for p, w in zip(pooled, weights)]
    return [p / len(text) for p in pooled]


def test_predictions_equal_plain_python(spark):
    docs = frame(spark, labelled(60))
    net = lid.fit(docs)
    texts = [(1, "the house and that water", None, None), (2, "très déjà où", None, None), (3, "漢字 and λ " * 9, None, None), (4, "x", None, None), (5, "le 12 " * 40, None, None)]
    for r in lid.predict(frame(spark, texts), net).collect():
        wanted = plain_document(net, r.text.encode())
        assert r.score == pytest.approx(max(wanted), abs=1e-4) and r.lang_pred == net.languages[wanted.index(max(wanted))]


def test_whole_texts_are_learned_from(spark):
    long = "é漢x" * 700
    rows = [(1, long, "zz", "a"), (3, "short text", "en", "a"), (4, "y", "fr", "a"), (4, "y", "fr", "a")]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    found = lid.labelled_windows(frame(spark, rows)).collect()
    texts = {r[1].encode() for r in rows}
    assert sorted(bytes(r.piece) for r in found) == sorted(p for t in texts for p in lid.cut(t))
    assert all(len(p) <= lid.WINDOW and p.decode() for p in lid.cut(long.encode())) and b"".join(lid.cut(long.encode())).decode() == long


def test_bounds_of_the_sample(spark):
    rows = [(n, f"text number {n} " * 30, f"l{n % 90}", "a") for n in range(900)]
    docs = frame(spark, rows)
    languages = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert {r.lang for r in lid.labelled_windows(docs, rows=5).collect()} == languages  # one row each at least
    few = lid.labelled_windows(docs, rows=200, windows=37).collect()
    assert len(few) == 37 and len({r.lang for r in few}) > 10  # from all over, not from the first
