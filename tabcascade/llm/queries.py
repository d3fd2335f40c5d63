"""The operators bound to the driver's tables: ``QUERIES`` and, where SQL can say it, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcascade.llm import alignment, chat, collocations, decontaminate, exact_dedup, gru_lm, jaccard, markov_secrets, orc_tokens, packing, quality, sharding, toxicity
from tabcascade.llm.common import buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHARDS = tuple(f"shard-{k:03d}" for k in range(64))
TOKENIZER = "word_bpe_49k.json"
PROBE = "\\### Assistant: </turn> ok"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t"),
    )
    probe = probe.select("conv_id", "t.turn", "t.role", F.lit(PROBE).alias("text"))
    records = chat.gather_records(rows.unionByName(probe))
    formatted = chat.format_chat(chat.canonical_turns(records, "record")).select("conv_id", "layout", "formatted", "loss_spans")
    back = chat.read_back(formatted)
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op1_chat_format"] = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
),
marked AS (
    SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')) AS body,
        length(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e'), chr(10), '\\n')) AS head
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + head + 1 + body + 8) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), quality.learn_from(5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (buckets("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(table(spark, folder, "documents"), width=3, percent=90).drop("row_hash")


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS)


_SLOT, _SHARD = sharding.placement_sql("doc_id", SHARDS)
ORACLE_SQL["op5_sharding"] = f"SELECT doc_id, {_SLOT} AS slot, {_SHARD} AS shard FROM documents"


@query
def op6_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = markov_secrets.scan(table(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("markov"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), quality.learn_from(4, 2))
    return quality.score(docs, model).select("doc_id", (buckets("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents")).drop("row_hash")


ORACLE_SQL["op8_exact_dedup"] = """
WITH bare AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents
),
ranked AS (
    SELECT doc_id, body, row_number() OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST) AS place,
        first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size
    FROM bare
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_hash")


@query
def op10_gru_lm(spark: SparkSession, folder: str) -> DataFrame:
    scored = gru_lm.score(table(spark, folder, "documents"), buckets("doc_id", 10) != 0)
    return scored.select("doc_id", (buckets("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    byte_level, pieces = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, folder, "documents"), byte_level, pieces)[0]


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


ORACLE_SQL["op12_collocations"] = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang HAVING sum(len(w)) > 0),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, unnest(list_transform(range(1, least(5, len(w) - i + 2)), lambda m: {'m': m, 'p': array_to_string(w[i : i + m - 1], ' ')})) AS g FROM places),
counts AS (SELECT lang, g.p AS phrase, any_value(g.m) AS m, count(*) AS c FROM grams GROUP BY lang, g.p HAVING count(*) >= 30),
around AS (
    SELECT lang, part, max(c) AS most FROM (
        SELECT lang, array_to_string(string_split(phrase, ' ')[1 : m - 1], ' ') AS part, c FROM counts WHERE m > 2
        UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2 : m], ' ') AS part, c FROM counts WHERE m > 2
    ) GROUP BY lang, part
),
candidates AS (
    SELECT c.* FROM counts c LEFT JOIN around o ON c.lang = o.lang AND c.phrase = o.part
    WHERE c.m > 1 AND (o.most IS NULL OR 100 * CAST(o.most AS HUGEINT) < 80 * CAST(c.c AS HUGEINT))
),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
    SELECT t.lang, t.phrase, t.c AS a, t.k, x.c AS l, y.c AS r, CAST((2000000 * CAST(t.c AS HUGEINT)) // (CAST(x.c AS HUGEINT) + y.c) AS BIGINT) AS score
    FROM cuts t JOIN counts x ON x.lang = t.lang AND x.phrase = array_to_string(string_split(t.phrase, ' ')[1 : t.k], ' ')
    JOIN counts y ON y.lang = t.lang AND y.phrase = array_to_string(string_split(t.phrase, ' ')[t.k + 1 : t.m], ' ')
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""


@query
def op13_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return orc_tokens.with_checksum(orc_tokens.read_tokens(spark, path))
