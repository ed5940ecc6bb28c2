"""The pipeline and its stages against plain Python on a small corpus."""

import random
import uuid

import pytest
import sentencepiece
from helpers import frame
from test_mixing import words
from test_simhash import brute_groups

import corpus_pipeline
from tablewright.llm import mixing
from tablewright.llm.queries import QUERIES, tokenizer
from tablewright.session import shared_folder

VOCABULARY = {"en": "the and of that with this from have water".split(), "fr": "le est dans pour où qui très déjà eau".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    dice, rows = random.Random(12), []
    for doc in range(150):
        lang = dice.choice(sorted(VOCABULARY))
        rows.append((doc, " ".join(dice.choices(VOCABULARY[lang], k=dice.randint(20, 80))), lang, dice.choice("abc")))
    rows += [(1000 + n, rows[n][1], "en", "a") for n in range(0, 30, 3)]  # exact copies
    long = [" ".join(dice.choices(VOCABULARY["en"], k=900)) for _ in range(3)]
    for n in range(12):  # near copies: two words of 900 differ
        text = long[n % 3].split()
        text[n * 40] = f"edit{n}"
        rows.append((2000 + n, " ".join(text), "en", "b"))
    rows += [(3000, None, "en", "a"), (3001, "", None, None), (3002, "12 34 -- 56", "en", "c")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, corpus):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4()}"
    frame(spark, corpus, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows = docs.columns, {r.doc_id: r for r in docs.collect()}

    def step(number):
        nonlocal docs
        made = corpus_pipeline.STAGES[number][1](spark, docs, folder)
        path = f"{folder}/{number}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        assert number == 4 or docs.columns == names
        return docs.collect()

    kept = step(0)
    assert {r.doc_id for r in kept} == set(rows) - {3000, 3001, 3002}
    last = {}
    for r in kept:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    exact = step(1)
    assert {r.doc_id for r in exact} == set(last.values()) and len(exact) == len(last)
    groups = brute_groups([(r.doc_id, r.text) for r in exact])
    near = step(2)
    assert {r.doc_id for r in near} == {c for _, _, c in groups} and len(near) < len(exact)
    assert {r.doc_id: r for r in near} == {r.doc_id: r for r in exact if r.doc_id in {n.doc_id for n in near}}
    taken = {r.doc_id: len(r.positions) for r in mixing.training_mix(docs).collect()}
    mixed = step(3)
    for doc, n in taken.items():
        assert sum(r.doc_id == doc for r in mixed) == n
    assert sum(words(r.text) for r in mixed) == pytest.approx(1.5 * sum(words(r.text) for r in near), rel=0.1)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    coded = step(4)
    assert sorted((r.doc_id, r.ids) for r in coded) == sorted((r.doc_id, library.encode(r.text)) for r in mixed)


def test_run_and_registry(spark, folder):
    import __spark_entry__ as contract

    found = contract.queries()
    assert found["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(found)
    made = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids"} <= set(made.columns) and made.count() > 100


def test_least_score_follows_the_number_of_languages():
    bounds = [corpus_pipeline.least_score(n) for n in (2, 3, 4, 40, 1000)]
    assert bounds == sorted(bounds, reverse=True) and all(1 / n < b < 1 / n + 0.1 for n, b in zip((2, 3, 4, 40, 1000), bounds))


@pytest.mark.parametrize("score, kept", [(0.54, False), (0.56, True)])
def test_texts_near_an_even_guess_go(spark, monkeypatch, score, kept):
    from pyspark.sql import functions as F

    from tablewright.llm import language_id

    class Two:
        languages = ["en", "fr"]

    monkeypatch.setattr(language_id, "fit", lambda docs: Two())
    guess = lambda docs, net, text: docs.withColumns({"lang_pred": F.lit("en"), "score": F.lit(score)})
    monkeypatch.setattr(language_id, "predict", guess)
    docs = frame(spark, [(1, "any text", "en", "a", 8)], SCHEMA)
    assert (corpus_pipeline.language_stage(spark, docs, "").count() == 1) == kept


def test_one_language_rejects_nothing_readable(spark):
    docs = frame(spark, [(n, f"some text of one language {n}", "en", "a", 9) for n in range(30)], SCHEMA)
    assert corpus_pipeline.language_stage(spark, docs, "").count() == 30


def test_no_labels(spark):
    docs = frame(spark, [(1, "some text", None, "a", 9), (2, "123", None, "a", 3), (3, None, None, None, None)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 14)])
def test_one_query_each(name):
    assert len([q for q in QUERIES if q.startswith(name + "_")]) == 1


def test_clashing_columns_and_empty(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "some text", "en", "a", 9), (2, "some text", "en", "a", 9)], SCHEMA)
    docs = docs.select("*", *[F.lit(1).alias(n) for n in ("keep_id", "target", "ids_", "_tw_x", "print", "root", "lang_pred", "score")])
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert set(stage(spark, docs, "").columns) == set(docs.columns)
        assert stage(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), "").collect() == []


def test_near_stage_goes_through_simhash(spark, monkeypatch):
    """Its links are candidates: enough where MinHash gives none, and checked on the whole sets."""
    from tablewright.llm import shingles, simhash

    dice = random.Random(5)
    phrase, own = "the same words again and " * 60, [" ".join(f"{c}{n}" for n in range(30)) for c in "uv"]
    unlike = [phrase + o for o in own]  # what comes often settles every bit, what differs most of the shingles
    first = dice.choices([f"w{n}" for n in range(500)], k=900)
    copies = [" ".join(first), " ".join([*first[:60], "edit", *first[61:]])]
    far = lambda pair: bin(simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])).count("1")
    alike = lambda pair: shingles.similar(*map(shingles.shingle_set, pair))
    assert far(unlike) <= 2 and not alike(unlike) and far(copies) <= 2 and alike(copies)
    texts = [*unlike, *copies, "a text of its own that is like no other one"]
    docs = frame(spark, [(n, text, "en", "a", 9) for n, text in enumerate(texts)], SCHEMA)
    with monkeypatch.context() as patch:
        patch.setattr(shingles, "_checked", lambda pairs, sets: pairs.select("a", "b").join(sets.select(sets.node.alias("b")), "b").select("a", "b"))
        proposed = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert proposed == {0, 2, 4}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {0, 1, 2, 4}


def test_rounds_of_small_graphs_are_small(spark):
    """A round of a few edges is one task at its start, however many partitions they came in."""
    from pyspark.sql import functions as F

    from tablewright.llm.components import components

    before, kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true"), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frames = type(spark.range(1))
    coalesce = frames.coalesce
    try:
        frames.coalesce = lambda self, n: kept.append((self.rdd.getNumPartitions(), n)) or coalesce(self, n)
        edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(40)
        made = components(edges).checkpoint()
    finally:
        frames.coalesce = coalesce
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert kept and all(n == 1 for _, n in kept) and kept[0][0] > 1
    assert {r.root for r in made.collect()} == {0} and made.select("node").distinct().count() == 401


def tasks(spark, group, work):
    """Tasks that ``work`` ran, and what it returned."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        made = work()
    finally:
        context._jsc.clearJobGroup()
    told = context.statusTracker()
    jobs = [told.getJobInfo(n) for n in told.getJobIdsForGroup(group)]
    return sum(stage.numCompletedTasks for job in jobs for n in job.stageIds if (stage := told.getStageInfo(n))), made


def test_rounds_of_small_graphs_deal_nothing_out(spark):
    """All rounds of a small graph take few tasks, however many shuffle partitions there are; large ones agree."""
    from pyspark.sql import functions as F

    from tablewright.llm import components as module

    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(name) for name in names]
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(500, 900).select("id", F.lit(450).cast("long").alias("b")).toDF("a", "b")
    edges = chain.unionByName(hub).coalesce(2)
    limit, found = module.EDGES, {}
    try:
        for name, value in zip(names, ["false", "20"]):
            spark.conf.set(name, value)
        for module.EDGES in (limit, 100):
            count, made = tasks(spark, f"rounds-{module.EDGES}", lambda: module.components(edges))
            found[module.EDGES] = count, sorted(map(tuple, made.collect()))
    finally:
        module.EDGES = limit
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert found[limit][1] == found[100][1] == [(n, 0) for n in range(301)] + [(n, 450) for n in [450, *range(500, 900)]]
    assert found[limit][0] < 150 < found[100][0]


def test_stored_frames_leave_no_shuffle_files(spark):
    """They go with the execution, not with the driver's garbage; the setting and the frame stay as they were."""
    import time

    from tablewright.llm.common import CLEANED, prepare, stored

    prepare(spark)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for n in range(found.size()) if "shuffle_" in (name := found.apply(n).getName())}

    before, setting = files(), spark.conf.get(CLEANED, None)
    rows = spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count()
    made, until = stored(rows), time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANED, None) == setting
    assert made.count() == 700 and rows.count() == 700 and rows.agg({"count": "sum"}).first()[0] == 5000
