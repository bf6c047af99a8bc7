"""Registered queries of this package: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import (
    collocations,
    context_mixing,
    fingerprints,
    learned_partitions,
    mixing,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    spelling,
    tool_calls,
    toxicity,
    url_filter,
)
from driftwatch.llm.url_filter import UrlRule
from driftwatch.llm.common import table


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the names of watched records."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.col("source").alias("collection_name")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), (1 - F.col("quality")).alias("degraded"), "toxic"
    )


CHAIN = ("degraded", "toxic")


URL_RULES = (
    UrlRule("org/", "allow"),
    UrlRule("example.org/es/", "block"),
    UrlRule("example.org/en/1", "block"),
    UrlRule("com/fr/", "allow"),
    UrlRule("com/de/", "block"),
)
TURN_SCHEMAS = {"reply": {"turn": "integer", "text": "string?"}, "instruct": {"turn": "integer", "text": "string"}}


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = watched(spark, sf_dir).select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = fingerprints.with_successor(
        fingerprints.add_fingerprints(docs), "document_id", ["text", "fingerprint"], keys=docs
    )
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(
        "document_id",
        n.alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        F.concat(F.substr("text", F.lit(1), n.cast("int") - half), F.substr("next_text", F.lit(1), half)).alias("edited"),
    )
    both = fingerprints.add_fingerprints(edited, "edited", "edited_fingerprint")
    return both.select(
        F.col("document_id").alias("doc_id"),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprints.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = watched(spark, sf_dir).select("document_id", "text")
    out = quality_classifier.held_out("document_id", 4, 2)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    weights = quality_classifier.fit_quality(docs.where(~out), labels.where(~out))
    scored = quality_classifier.score_quality(docs.withColumn("held_out", out), weights)
    return scored.select(F.col("document_id").alias("doc_id"), "held_out", "score", "predicted")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as calls (user, system) and their results (the assistant's next turn)."""
    turns = table(spark, sf_dir, "conversations").withColumn("incident_id", F.col("conv_id").cast("string"))
    call_id = F.format_string("%s:%06d", "incident_id", "turn")
    before = lambda k: F.format_string("%s:%06d", F.col("incident_id"), F.col("turn") - k)
    answer = F.col("role") == "assistant"
    calls = turns.where(~F.coalesce(answer, F.lit(False))).select(
        "incident_id",
        call_id.alias("call_id"),
        F.when(F.col("role") == "system", "instruct").otherwise("reply").alias("tool_name"),
        F.to_json(F.struct("turn", "text")).alias("args"),
        F.when(F.col("turn") >= 2, before(2)).when(F.col("turn") == 1, before(1)).alias("after"),
    )
    results = turns.where(answer).select("incident_id", before(1).alias("call_id"), F.col("text").alias("response"))
    linked = tool_calls.link_tool_calls(calls, results, TURN_SCHEMAS)
    return linked.withColumn("conv_id", F.col("incident_id").cast("long")).drop("incident_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), URL_RULES, url_filter.declared_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.held_out("document_id", 10, 0)
    scored = context_mixing.score_texts(watched(spark, sf_dir).withColumn("train", ~out))
    return scored.select(
        F.col("document_id").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        *("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(watched(spark, sf_dir), width=2, percent=80)
    return found.withColumnRenamed("document_id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_quality_rules(watched(spark, sf_dir))
    return judged.select(
        F.col("document_id").alias("doc_id"),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_collections(watched(spark, sf_dir))
    return mixed.select(
        F.col("document_id").alias("doc_id"), F.col("collection_name").alias("source"), "block", "release", "deadline", "slot"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = watched(spark, sf_dir)
    pieces = packing.token_pieces(docs, vocabulary())
    digests = pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    return packing.pack_pieces(digests, rows=docs.count()).withColumnRenamed("document_id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = watched(spark, sf_dir)
    model = toxicity.fit_chain(docs, toxicity_labels(spark, sf_dir), CHAIN)
    scored = toxicity.predict_chain(docs.select("document_id", "text"), model)
    return scored.select(
        F.col("document_id").alias("doc_id"),
        *[f"p_{c}" for c in CHAIN],
        toxicity.flag(model, "toxic").alias("toxic"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(watched(spark, sf_dir))


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("incident_id"), "embedding")
    queries = history.where("incident_id % 50 = 0").withColumnRenamed("incident_id", "query_id")
    found = learned_partitions.learned_neighbours(queries, history, k=5)
    return found.withColumnRenamed("incident_id", "vec_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_tool_calls": op3_tool_calls,
    "op4_context_mixing": op4_context_mixing,
    "op6_url_filter": op6_url_filter,
    "op5_near_duplicates": op5_near_duplicates,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_learned_partitions": op12_learned_partitions,
    "op13_collocations": op13_collocations,
}

# every phrase of one to four words is listed and counted, then cut and scored
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (SELECT lang, a, w, k, unnest(range(1, k)) AS i FROM candidates WHERE k > 2),
inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM spans) WHERE j - i + 1 < k GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
ORACLES: dict[str, str] = {"op13_collocations": OP13_SQL}
