"""Quality rules: counted rules, and bands of the perplexity under an n-gram model of the language.

*Model.* Modified Kneser-Ney over characters (white space runs are one space, texts padded), so that no
script needs words or a fixed vocabulary. Distinct n-grams are counted in blocks of documents and added up
by Spark; continuation counts, discounts, back-off weights and interpolated probabilities are grouped sums
and joins over distinct n-grams. Two models for each language hold the documents of one half of the text
hashes each, and a text is scored by the model of the other half: nothing vouches for itself.

*Scores.* The model is stored in parts, each a sorted array of 64-bit hashes with probabilities and back-off
weights. A block asks the parts for the n-grams that it holds; what comes back is one probability for
each distinct n-gram (and a weight for each context), so model and corpus may both be of any size: nothing is broadcast, a task holds one
part or one block. Hashes stand for n-grams: two that share one (never seen below billions of n-grams)
would share their probability.

Documents are read twice, to count and to score, and have to come alike: a stored table does, and after a shuffle
or another step that may deal rows differently they should be stored first. A block whose texts are not those
that were counted is an error, never a wrong score.

*Bands.* A language's bits per character over all documents that pass the counted rules give exact quartiles
(of hundredths); the band reaches ``REACH`` interquartile ranges, at least ``LEAST_REACH`` bits, beyond them on
both sides. Bands may also be given. Documents outside are rejected.

Results: one row per document, repeated rows included. Null and empty texts have no word and fail the
counted rules. A null language is ``und``. Where the other half of a language is empty there is no
perplexity and no verdict against a document, as there is for a text without a word. An empty table gives an empty
one. Ties in perplexity share their verdict; other columns are ignored. A text is worked whole, in memory in
proportion to its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import blocks
from .common import prepare, quoted

ORDER = 3
REACH, LEAST_REACH = 6.0, 0.4
BLOCK = 4 * 1024 * 1024  # bytes of text in a block
MOST_CODES = 1 << 22  # possible n-grams that are counted by code, not by sorting
TEXTS = 1 << 20  # bytes of texts that are counted at once
PART = 1 << 20  # entries of a part of the model, and n-grams a part is asked for
NO_LANG, PAD = "und", "\n"
LEAST_WORDS, MOST_REPEATED = 50, 50


# --- counted rules -------------------------------------------------------------------------

_SYMBOLS, _BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in three-word windows that it holds twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    ids = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    if len(ids) < 3:
        return np.zeros(len(words), np.int64)
    place = np.flatnonzero(doc[:-2] == doc[2:])
    # Most windows are unlike all others already by a hash; only the rest are compared exactly.
    with np.errstate(over="ignore"):
        mixed = doc[place].astype(np.uint64)
        for n in range(3):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + ids[place + n].astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(words), np.int64)
    place = place[twice[np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)] == mixed]
    two = np.unique(ids[place] << 32 | ids[place + 1], return_inverse=True)[1]
    three = np.unique(two << 32 | ids[place + 2], return_inverse=True)[1]
    _, at, count = np.unique(three << 32 | doc[place], return_inverse=True, return_counts=True)
    marked = np.zeros(len(ids), bool)
    for n in range(3):
        marked[place[count[at] > 1] + n] = True
    return np.bincount(doc, marked, len(words)).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            repeated += line in seen
            seen.add(line)
    return repeated


def counted(texts: list[bytes]) -> dict[str, pa.Array]:
    words = [t.split() for t in texts]
    points = lambda t: len(t) if t.isascii() else len(t.decode(errors="replace"))
    columns = {
        "n_words": [len(w) for w in words],
        "word_chars": [points(t) - sum(t.count(b) for b in _BLANKS) for t in texts],
        "n_symbols": [sum(t.count(s) for s in _SYMBOLS) for t in texts],
        "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeated_words(words),
    }
    return {name: pa.array(values, pa.int64()) for name, values in columns.items()}


def _portions(texts: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """Texts, null as empty, a bounded number of bytes at a time (or one text)."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- n-grams of a block --------------------------------------------------------------------

def _half(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 5) & 1


class Grams:
    """Distinct n-grams (of characters) of some texts, their counts, and those of each text."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        pad = np.full(order - 1, ord(PAD), np.uint32)
        parts, self.lengths = [pad[:0]], []
        for text in texts:
            line = b" ".join(text.split()).decode(errors="replace").replace("\0", "�")
            parts += [pad, np.frombuffer((line + PAD).encode("utf-32-le"), np.uint32)]
            self.lengths.append(len(line) + 1)
        points = np.concatenate(parts)
        # Places whose n-gram ends in a text: all but those that end in the padding before one.
        ends = np.cumsum([order - 1 + n for n in self.lengths])
        keep = np.ones(len(points), bool)
        for n in range(order - 1):
            keep[ends - np.array(self.lengths) - 1 - n] = False
        starts = np.flatnonzero(keep) - (order - 1)
        del keep
        # Characters by their number among those of the texts: few, so n-grams mostly have small codes.
        used = np.zeros(0x110000, bool)
        used[points] = True
        letters = np.flatnonzero(used).astype(np.uint32)
        rank = np.zeros(0x110000, np.int32)
        rank[letters] = np.arange(len(letters), dtype=np.int32)
        ids = rank[points]
        del points, used, rank
        if len(letters) ** order <= MOST_CODES:
            code = np.zeros(len(starts), np.int32)
            for n in range(order):
                code = code * np.int32(len(letters)) + ids[starts + n]
            often = np.bincount(code, minlength=1)
            found = np.flatnonzero(often)
            self.counts, place = often[found], np.zeros(len(often), np.int32)
            place[found] = np.arange(len(found), dtype=np.int32)
            self.at = place[code]
            first = np.zeros(len(found), np.int64)
            first[self.at] = np.arange(len(code))
        else:
            # Exact codes, one character more at a time.
            code = ids[starts].astype(np.int64)
            for n in range(1, order):
                code = np.unique(code, return_inverse=True)[1].astype(np.int64) * len(letters) + ids[starts + n]
            _, first, self.at, self.counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        windows = letters[ids[starts[first][:, None] + np.arange(order)]]
        self.grams = np.ascontiguousarray(windows).view(f"<U{order}").ravel().tolist()


def _groups(data: bytes) -> Iterator[tuple[str, int, np.ndarray, list[bytes]]]:
    """Texts with a word of a block, by language and half: language, half, rows, texts."""
    rows, found = blocks.unpacked(data), {}
    for n, (lang, text) in enumerate(zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist())):
        if text and text.strip():
            at, texts = found.setdefault((NO_LANG if lang is None else lang, _half(text)), ([], []))
            at.append(n)
            texts.append(text)
    for (lang, half), (at, texts) in sorted(found.items()):
        yield lang, half, np.array(at), texts


COUNTED = "block long, digest long, lang string, half int, grams array<string>, counts array<long>"


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, digest, data in zip(batch.column("block").to_pylist(), batch.column("digest").to_pylist(), batch.column("data")):
                for lang, half, _, texts in _groups(data.as_py()):
                    own = Grams(texts, order)
                    columns = [
                        pa.array([block], pa.int64()), pa.array([digest], pa.int64()), pa.array([lang]), pa.array([half], pa.int32()),
                        pa.array([own.grams], pa.list_(pa.string())), pa.array([own.counts.tolist()], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=_names(COUNTED))

    return run


# --- the model -----------------------------------------------------------------------------

def _discounts(counts: DataFrame) -> DataFrame:
    """``lang, half, d1, d2, d3`` from the numbers of n-grams seen one to four times."""
    often = [F.count_if(F.col("c") == n).alias(f"n{n}") for n in range(1, 5)]
    made = counts.groupBy("lang", "half").agg(*often).withColumn("y", F.expr("try_divide(n1, n1 + 2 * n2)"))
    # Where counts are too few for an estimate, or it leaves nothing to what is unseen: half of the count.
    estimate = {n: f"try_divide({n} * n{n} - {n + 1} * y * n{n + 1}, n{n})" for n in (1, 2, 3)}
    own = {f"d{n}": F.expr(f"CASE WHEN {e} > 0 THEN least({n}D, {e}) ELSE {n / 2}D END") for n, e in estimate.items()}
    return made.select("lang", "half", *[value.alias(name) for name, value in own.items()])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, half, gram, prob, backoff`` from ``lang, half, gram, c`` of the longest n-grams.

    ``prob`` is interpolated over all orders; ``backoff`` is the weight that a context leaves to the shorter
    one. The empty n-gram has the even share of a character and the weight left to it.
    """
    by_order = {order: counts}
    for n in range(order - 1, 0, -1):
        longer = by_order[n + 1]
        by_order[n] = longer.groupBy("lang", "half", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
    known = by_order[1].groupBy("lang", "half").agg((F.lit(1) / (F.count("*") + 1)).alias("prob"))
    probs, found = known.withColumn("gram", F.lit("")), []
    weights = []
    for n in range(1, order + 1):
        cut = by_order[n].withColumns({"ctx": F.expr(f"substring(gram, 1, {n - 1})"), "suffix": F.expr("substring(gram, 2)")})
        cut = cut.join(_discounts(by_order[n]), ["lang", "half"]).withColumn("d", F.expr("CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        context = cut.groupBy("lang", "half", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("backoff"))
        lower = probs.select("lang", "half", F.col("gram").alias("suffix"), F.col("prob").alias("lower"))
        joined = cut.join(context, ["lang", "half", "ctx"]).join(lower, ["lang", "half", "suffix"])
        found.append(probs)
        probs = joined.select("lang", "half", "gram", F.expr("greatest(c - d, 0D) / total + backoff * lower").alias("prob"))
        if n < order:
            probs = probs.checkpoint()
        weights.append(context.select("lang", "half", F.col("ctx").alias("gram"), "backoff"))
    found.append(probs)
    names = ["lang", "half", "gram"]
    every = reduce(DataFrame.unionByName, [p.select(*names, "prob", F.lit(None).cast("double").alias("backoff")) for p in found])
    every = reduce(DataFrame.unionByName, [every, *[w.select(*names, F.lit(None).cast("double").alias("prob"), "backoff") for w in weights]])
    return every.groupBy(*names).agg(F.max("prob").alias("prob"), F.max("backoff").alias("backoff"))


def _key(half: int, lang: str, grams: list[str]) -> np.ndarray:
    before = f"{half}{lang}{PAD}{PAD}"
    return np.array([xxhash.xxh64_intdigest((before + g).encode(), 42) for g in grams], np.uint64).view(np.int64)


def _packed_part(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("key").to_numpy(), kind="stable")
    columns = [rows.column("part").slice(0, 1)]
    for name, kind in (("key", np.int64), ("prob", np.float32), ("backoff", np.float32)):
        values = rows.column(name).to_numpy().astype(kind)[order]
        columns.append(pa.array([values.tobytes()], pa.binary()))
    return pa.table(columns, names=["part", "keys", "probs", "backoffs"])


def stored_model(model: DataFrame) -> tuple[DataFrame, int]:
    """The model as parts of sorted hash arrays, written to the shared folder, and their number."""
    spark = model.sparkSession
    key = F.xxhash64(F.concat(F.col("half").cast("string"), "lang", F.lit(PAD * 2), "gram"))
    rows = model.select(key.alias("key"), F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("backoff", F.lit(1.0)).alias("backoff")).checkpoint()
    parts = max(1, -(-rows.count() // PART))
    packed = rows.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_packed_part, "part int, keys binary, probs binary, backoffs binary")
    path = f"{shared_folder(spark)}/model-{uuid.uuid4()}"
    packed.write.parquet(path)
    return spark.read.parquet(path), parts


# --- scores --------------------------------------------------------------------------------

def _asked(half: int, lang: str, grams: list[str], parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, the keys that some texts need to know: first of the ends and contexts of their
    n-grams (probability and weight), then of the n-grams (probability), each rising."""
    shorter = {""}
    for gram in grams:
        for n in range(len(gram)):
            shorter.add(gram[n + 1 :])
            shorter.add(gram[n:-1])
    low, top = (np.unique(_key(1 - half, lang, list(some))) for some in (shorter, grams))
    return [(low[low % parts == part], top[top % parts == part]) for part in range(parts)]


ASKED = "part int, block long, digest long, lang string, half int, n_low int, keys binary"


def _asker(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(part, len(low), np.concatenate((low, top))) for part, (low, top) in enumerate(_asked(row["half"], row["lang"], row["grams"], parts)) if len(low) + len(top)]
                same = [pa.array([row[name]] * len(found), kind) for name, kind in (("block", pa.int64()), ("digest", pa.int64()), ("lang", pa.string()), ("half", pa.int32()))]
                columns = [pa.array([p for p, _, _ in found], pa.int32()), *same, pa.array([n for _, n, _ in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([k.tobytes() for _, _, k in found], pa.binary())], names=_names(ASKED))

    return run


ANSWER = "block long, digest long, lang string, half int, part int, probs binary, backoffs binary"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What is asked for, in the order asked: 0 for n-grams that the model does not have, 1 for weights."""
    known, of, left = np.empty(0, np.int64), np.zeros(1, np.float32), np.ones(1, np.float32)
    if model.num_rows:
        known, of, left = (np.frombuffer(model.column(n)[0].as_py(), k) for n, k in (("keys", np.int64), ("probs", np.float32), ("backoffs", np.float32)))
    probs, backoffs = [], []
    for keys, low in zip(asked.column("keys"), asked.column("n_low").to_pylist()):
        wanted = np.frombuffer(keys.as_py(), np.int64)
        at = np.clip(np.searchsorted(known, wanted), 0, max(0, len(known) - 1))
        held = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
        probs.append(np.where(held, of[at], np.float32(0)).astype(np.float32).tobytes())
        backoffs.append(np.where(held, left[at], np.float32(1))[:low].astype(np.float32).tobytes())
    columns = [asked.column(n) for n in ("block", "digest", "lang", "half", "part")]
    return pa.table([*columns, pa.array(probs, pa.binary()), pa.array(backoffs, pa.binary())], names=_names(ANSWER))


def _learned(asked: list[tuple[np.ndarray, np.ndarray]], answers: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rising, with their probabilities and weights, from the answers of all parts."""
    keys, probs, backoffs = [np.empty(0, np.int64)], [np.empty(0, np.float32)], [np.empty(0, np.float32)]
    for part, (low, top) in enumerate(asked):
        if len(low) + len(top):
            prob, backoff = answers[part]
            keys += [low, top]
            probs.append(np.frombuffer(prob, np.float32))
            backoffs += [np.frombuffer(backoff, np.float32), np.ones(len(top), np.float32)]
    keys, probs, backoffs = np.concatenate(keys), np.concatenate(probs), np.concatenate(backoffs)
    order = np.argsort(keys, kind="stable")
    return keys[order], probs[order], backoffs[order]


def log_probabilities(grams: list[str], half: int, lang: str, keys: np.ndarray, probs: np.ndarray, backoffs: np.ndarray) -> np.ndarray | None:
    """Bits of each n-gram's last character given those before it; ``keys`` are sorted. None without a model."""

    def look(names: list[str], values: np.ndarray, missing: float) -> np.ndarray:
        own, at = np.unique(np.array(names), return_inverse=True)
        wanted = _key(1 - half, lang, own.tolist())
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, values[place], missing)[at].astype(float)

    if not len(keys) or look([""], probs, 0.0)[0] == 0:
        return None
    weight, found = np.ones(len(grams)), np.zeros(len(grams))
    for n in range(len(grams[0]) + 1):
        prob = look([g[n:] for g in grams], probs, 0.0)
        if n == len(grams[0]):
            prob = np.full(len(grams), look([""], probs, 0.0)[0])
        found = np.where(found > 0, found, weight * prob)
        if n < len(grams[0]):
            weight *= look([g[n:-1] for g in grams], backoffs, 1.0)
    return np.log2(found)


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(order: int, parts: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        given: dict[tuple[str, int], dict[int, tuple[bytes, bytes]]] = {}
        for row in answers.to_pylist():
            given.setdefault((row["lang"], row["half"]), {})[row["part"]] = (row["probs"], row["backoffs"])
        if set(answers.column("digest").to_pylist()) - set(block.column("digest").to_pylist()):
            raise RuntimeError("the documents came in another order when they were read again: store them first")
        made = []
        for data in block.column("data"):
            data = data.as_py()
            rows = blocks.unpacked(data)
            bits = np.full(rows.num_rows, np.nan)
            for lang, half, at, texts in _groups(data):
                own = Grams(texts, order)
                learned = _learned(_asked(half, lang, own.grams, parts), given.pop((lang, half)))
                cost = log_probabilities(own.grams, half, lang, *learned)
                if cost is not None:
                    doc = np.repeat(np.arange(len(texts)), own.lengths)
                    bits[at] = -np.bincount(doc, cost[own.at], len(texts)) / np.array(own.lengths)
            langs = pa.array([NO_LANG if x is None else x for x in rows.column("lang").to_pylist()], pa.string())
            rules = [pa.concat_arrays(c) for c in zip(*[counted(some).values() for some in _portions(rows.column("text"))])]
            columns = [rows.column("id").combine_chunks(), langs, *rules, pa.array(bits, from_pandas=True)]
            made.append(pa.table(columns, names=["_tw_id", "lang", *RULES, "bits"]))
        return pa.concat_tables(made)

    return run


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, block_bytes: int = BLOCK) -> DataFrame:
    """``_tw_id, lang``, the counted rules and ``bits`` (per character, null without a model) of each document."""
    spark = prepare(docs.sparkSession)
    held = blocks.numbered(docs, quoted(text), block_bytes, id=quoted(id), lang=quoted(lang)).select("block", "digest", "data")
    path = f"{shared_folder(spark)}/grams-{uuid.uuid4()}"
    held.mapInArrow(_counter(order), COUNTED).write.parquet(path)
    own = spark.read.schema(COUNTED).parquet(path)
    each = own.select("lang", "half", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("lang", "half", F.col("g.grams").alias("gram"), F.col("g.counts").alias("c"))
    counts = each.groupBy("lang", "half", "gram").agg(F.sum("c").alias("c")).checkpoint()
    model, parts = stored_model(kneser_ney(counts, order))
    # As many parts as keep what one is asked for within bounds, whatever the number of blocks.
    asked = own.selectExpr("coalesce(sum(size(grams)), 0)").first()[0]
    pieces = max(1, -(-asked // (PART * parts)))
    requests = own.mapInArrow(_asker(parts), ASKED).withColumn("piece", F.pmod(F.xxhash64("block"), F.lit(pieces)).cast("int"))
    spread = model.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    answers = requests.groupBy("part", "piece").cogroup(spread.groupBy("part", "piece")).applyInArrow(_answers, ANSWER)
    kind = docs.schema[id].dataType
    rules = ", ".join(f"{name} long" for name in RULES)
    pair = held.groupBy("block").cogroup(answers.groupBy("block"))
    return pair.applyInArrow(_scorer(order, parts), f"_tw_id {kind.simpleString()}, lang string, {rules}, bits double")


def base_failed():
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def bands(rows: DataFrame, reach: float = REACH, least: float = LEAST_REACH) -> DataFrame:
    """``lang, low, high`` from ``lang, bits``: exact quartiles of hundredths of bits, by a small histogram."""
    bins = rows.where("bits IS NOT NULL").groupBy("lang", F.round(F.col("bits") * 100).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # A language has one row for each hundredth of a bit.
    so_far = Window.partitionBy("lang").orderBy("bin")
    placed = bins.withColumns({"upto": F.sum("n").over(so_far), "all": F.sum("n").over(Window.partitionBy("lang"))})
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / 100
    found = placed.groupBy("lang").agg(quarter(0.25).alias("q1"), quarter(0.75).alias("q3"))
    wide = F.greatest(F.lit(least), F.lit(reach) * (F.col("q3") - F.col("q1")))
    return found.select("lang", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def quality(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
    reach: float = REACH, given: DataFrame | None = None, block_bytes: int = BLOCK,
) -> DataFrame:
    """One row per document: id, the counted rules, ``base_failed``, ``kept``, ``bits`` per character,
    and the ``low`` and ``high`` of its language. ``given`` replaces the bands by a table of one's own."""
    rows = scored(docs, id, text, lang, order, block_bytes).withColumn("base_failed", base_failed()).checkpoint()
    limits = bands(rows.where("NOT base_failed"), reach) if given is None else given.select("lang", "low", "high")
    judged = rows.join(limits, "lang", "left")
    inside = F.expr("coalesce(bits BETWEEN low AND high, true)")
    verdict = (~F.col("base_failed") & inside).alias("kept")
    return judged.select(F.col("_tw_id").alias(id), *RULES, "base_failed", verdict, "bits", "low", "high")
