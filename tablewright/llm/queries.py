"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (
    chat_format,
    exact_dedup,
    language_id,
    lexical,
    metric_search,
    mixing,
    perplexity,
    personal_data,
    phrases,
    piece_codec,
    sharding,
    simhash,
    token_counts,
)
from .common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(configure(spark))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language_id.identify(table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("""
WITH v AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum([p[1] * p[2] for p in list_zip(q.w, c.w)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op2_mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    return metric_search.top_products(table(spark, folder, "embeddings"))


@query()
def op3_simhash_pigeonring(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query()
def op4_token_counts(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = token_counts.vocabulary(model or tokenizer("piece_bpe_32k.model"))
    return token_counts.count_tokens(docs, *pieces).select("doc_id", "n_words", "n_tokens", "n_unknown")


@query()
def op5_sentencepiece_codec(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = piece_codec.encode_pieces(docs, model or tokenizer("piece_bpe_32k.model"), columns=piece_codec.DIGESTS)
    return coded.select("doc_id", *piece_codec.DIGESTS)


@query()
def op6_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    law = F.lit("rows").alias("law")
    made = sharding.uniform_shards(sized)
    return made.select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = [kind.name for kind in personal_data.BASE]
    added = [kind.name for kind in personal_data.ADDED]
    counts = [F.size(name).cast("long").alias(f"n_{name}") for name in base]
    spans = personal_data.joined([*base, *added]).alias("spans")
    return found.select("doc_id", *counts, F.sha2(personal_data.joined(base), 256).alias("base_sha256"), spans)


@query("""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


@query()
def op9_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.training_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "positions")


PROBE = "</s>[INST] ok [/INST]"


def _chat_sql(template: chat_format.Template = chat_format.LLAMA) -> str:
    """The digests from the turns themselves: marks and backslashes are counted, not written."""
    first, rests = chat_format._rests(template)
    marks = " ".join(f"WHEN '{n}' THEN {len(r.before) + len(r.after)}" for n, r in template.roles.items())
    other = len((template.unknown.before + template.unknown.after).replace("{role}", ""))
    name = "length(role) + len(regexp_extract_all(role, '[\\\\\\[\\]]'))"
    moves = ", ".join(f"('{a}', '{b}')" for a, after in template.order.items() for b in after if b != chat_format.END)
    ends = ", ".join(f"'{a}'" for a, after in template.order.items() if chat_format.END in after)
    learned = "role IN (" + ", ".join(f"'{n}'" for n, r in template.roles.items() if r.learned) + ")"
    order = "ORDER BY turn, role, text"
    return f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')
), p AS (
    SELECT *, coalesce(lag(role) OVER w, '{chat_format.START}') AS state, lead(role) OVER w IS NULL AS last,
           length(text) + len(regexp_extract_all(text, '[{first}]\\\\*(?:{rests})')) + CASE role {marks} ELSE {other} + {name} END AS size
    FROM t WINDOW w AS (PARTITION BY conv_id {order})
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER ({learned}), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER ({learned}), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       bool_and((state, role) IN ({moves}) AND (NOT last OR role IN ({ends}))) AS in_order
FROM p GROUP BY conv_id"""


@query(_chat_sql())
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role")) for n, r in enumerate(("user", "assistant"))]))
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles.alias("r"), F.lit(PROBE).alias("text"))
    every = turns.unionByName(probe.select("conv_id", "r.turn", "r.role", "text"))
    made = chat_format.digests(chat_format.formatted(chat_format.segments(every)))
    return made.withColumnRenamed("conversation", "conv_id")


@query("""
WITH d AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark
), total AS (
    SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), o AS (
    SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY ALL
), df AS (
    SELECT term, count(*) AS df FROM o GROUP BY term
), q AS (
    SELECT item_id, term, count(*) AS qtf FROM b GROUP BY ALL
), s AS (
    SELECT q.item_id, d.doc, any_value(d.doc_id) AS doc_id,
           CAST(sum(qtf * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * docs) // terms)))) AS BIGINT) AS score
    FROM q JOIN df USING (term) JOIN o USING (term) JOIN d USING (doc), total
    GROUP BY q.item_id, d.doc
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
""")
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.Index(table(spark, folder, "documents"))
    return lexical.search(index, table(spark, folder, "benchmark"))


@query("""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), p AS (
    SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), o AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
    FROM w, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL
), n AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cut AS (
    SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
    FROM c, (VALUES (1), (2)) cuts(cut) WHERE cut < k
), s AS (
    SELECT cut.*, x.f AS l, y.f AS r,
           CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y
), low AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
), longer AS (
    SELECT lang, phrase, max(a) AS f FROM around GROUP BY ALL
), ranked AS (
    SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
    FROM low JOIN n USING (lang) LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
""")
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query()
def op13_ngram_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.quality(table(spark, folder, "documents"))
