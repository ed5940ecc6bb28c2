import hashlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, awkward, clashing, frame, plain
from pyspark.sql import functions as F

from tablewright.llm import bloom, exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        digest, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            kept = i == best and left == 1
            left -= kept
            out.append((i, best, len(ids), kept, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [1, 2, bloom.WORDS])
def test_groups_do_not_depend_on_the_filter(spark, words):
    assert plain(exact_dedup.mark_copies(frame(spark), words=words)) == expected(awkward())


@pytest.mark.parametrize("words", [1, bloom.WORDS])
def test_drop_copies(spark, words):
    docs = clashing(frame(spark), ["kept", "_tw_row", "_tw_hash", "keep_id"])
    left = exact_dedup.drop_copies(docs, words=words)
    wanted = sorted(((i, t) for i, _, _, kept, t in expected(awkward()) if kept), key=repr)
    got = left.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    assert plain(got) == wanted and {"kept", "keep_id", "lang"} <= set(left.columns)


def test_rows_without_copies_pass_the_filter(spark):
    marked = exact_dedup.possibly_repeated(frame(spark, [(n, f"text {n}", "en", "a") for n in range(500)]))
    assert marked.where("_tw_repeated").count() <= 2


def test_hot_group_and_empty(spark):
    rows = [(n, "same" if n % 3 else f"t{n}", "en", "a") for n in range(3000)]
    assert plain(exact_dedup.mark_copies(frame(spark, rows))) == expected(rows)
    assert exact_dedup.mark_copies(frame(spark, [], SCHEMA)).collect() == []
    assert exact_dedup.drop_copies(frame(spark, [], SCHEMA)).collect() == []


def test_filter_misses_no_key(spark):
    rows = spark.range(2000)
    for words in (4, 1 << 12):
        held = bloom.filled(rows.where("id % 2 = 0"), F.col("id"), words)
        found = bloom.tested(rows, F.col("id"), held, "hit", words)
        assert found.where("id % 2 = 0 AND NOT hit").count() == 0
        if words > 4:
            assert found.where("id % 2 = 1 AND hit").count() < 50
