"""The registered queries of the operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyspark.llm.bestfit import best_fit_pack
from supplyspark.llm.bpe import decode_documents, encode_documents
from supplyspark.llm.chat import ESCAPE, Template, format_turns, read_back, text_parts, with_turns
from supplyspark.llm.common import read, texts_of
from supplyspark.llm.exact import exact_groups
from supplyspark.llm.fim import fill_in_middle, restored
from supplyspark.llm.language_model import score, train
from supplyspark.llm.lexical import LexicalIndex
from supplyspark.llm.materialize import read_shards, write_shards
from supplyspark.llm.neighbours import GraphIndex
from supplyspark.llm.packing import pack
from supplyspark.llm.pii import BASE_KINDS, find_personal_data
from supplyspark.llm.sketch import near_duplicates
from supplyspark.llm.toxicity import fit, held_out, score_texts


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = find_personal_data(read(spark, sf_dir, "documents"))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sequence, read back from the shards."""
    docs = read(spark, sf_dir, "documents")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_shards(manifest).select("slot", "shard", "byte_offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# Escaping has to hold for texts made of another template's control strings.
CONTROL_TURNS = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_turns(read(spark, sf_dir, "conversations"), CONTROL_TURNS)
    return read_back(format_turns(turns, text_parts(F.col("text"))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_texts(texts_of(docs), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = train(docs.filter(~apart))
    return score(docs, model).select(
        "doc_id",
        apart.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(read(spark, sf_dir, "documents"), path, pattern)
    return decode_documents(encoded, path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphIndex(read(spark, sf_dir, "embeddings")).search(F.col("vec_id") % 100 == 0)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LexicalIndex(read(spark, sf_dir, "documents")).search(read(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit_pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_packing": op3_packing,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_graph_ann": op10_graph_ann,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
}


def _escaped_sql(column: str) -> str:
    text = f"replace({column}, '{ESCAPE}', '{ESCAPE}{ESCAPE}')"
    for control in Template().controls:
        text = f"replace({text}, '{control}', '{control[0]}{ESCAPE}{control[1:]}')"
    return text


# For DuckDB. The other operators have no SQL form; tests/llm compares them with brute force.
ORACLE: dict[str, str] = {
    "op4_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), escaped AS (
            SELECT *,
                   {_escaped_sql("role")} AS safe_role,
                   {_escaped_sql("text")} AS safe_text
            FROM turns
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(safe_role) + length(safe_text) + 12 + 10 + 10) AS BIGINT) AS formatted_chars
        FROM escaped
        GROUP BY conv_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), lengths AS (
            SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
        ), total AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
        ), norms AS (
            SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM lengths, total
        ), counts AS (
            SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY doc_id, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (doc_id)
            GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores
        WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
    "op12_fill_in_middle": """
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   [CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * g - 7, 8) AS BIGINT) FOR g IN [1, 2, 3, 4]] AS h
            FROM documents
        ), cuts AS (
            SELECT doc_id, text, units, len(units) AS n,
                   least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
                   greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), parts AS (
            SELECT doc_id, text, n, form,
                   array_to_string(units[1:a], '') AS prefix,
                   array_to_string(units[a + 1:b], '') AS middle,
                   array_to_string(units[b + 1:n], '') AS suffix
            FROM cuts
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
