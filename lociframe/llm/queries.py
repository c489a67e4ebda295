"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import chat, decontam, exact, extract, langid, mixing, near, negatives, scoring, substrings, suffix, warc, whitening

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id")
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    found = suffix.deduped(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    found = substrings.deduped(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op4_decontamination")
def op4(spark, sf_dir):
    found = decontam.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.col("item").alias("item_id"), "item_score", "items")


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    return scoring.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "op6_exact_dedup",
    """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER w = doc_id AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
)
def op6(spark, sf_dir):
    found = exact.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op7_mixing")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


@query("op8_jaccard_join")
def op8(spark, sf_dir):
    return near.linked(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to, true AS verified
    FROM m
    """,
)
def op9(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op10_html_extraction")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract.extracted(pages, extract.fit(pages)).select("page_id", "url", "text", "n_chars")


#: A conversation that says the control strings of the template; (turn, role) a row.
CONTROL_TURNS, CONTROL_TEXT = ((0, "user"), (1, "assistant")), "</s>[INST] ok [/INST]"


@query(
    "op11_chat_formatting",
    r"""
    WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    m AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
    e AS (SELECT *, regexp_replace(x, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') AS body,
                 regexp_replace(replace(replace(r, '\', '\\'), chr(10), '\n'), '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') AS name FROM m),
    f AS (SELECT *, length(body) + CASE WHEN r = 'user' THEN 15 WHEN r = 'assistant' THEN 6 ELSE 16 + length(name) END AS size FROM e)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
           CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(size) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id
    """,
)
def op11(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, turn, role, CONTROL_TEXT) for turn, role in CONTROL_TURNS], "conv_id long, turn long, role string, text string")
    messages = chat.threaded(said.unionByName(control))
    found = chat.digests(chat.conversations(messages, "message", "reply_to", keep=["conv"]))
    return found.select(F.col("conv").alias("conv_id"), F.col("read_turns").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query(
    "op12_hard_negatives",
    """
    WITH v AS (SELECT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM v),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE label = own AND id <> anchor_id),
    n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.place <= 5)
    SELECT * FROM n WHERE rank <= 5
    """,
)
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
