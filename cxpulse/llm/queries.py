"""The registered queries of this package: thin ``opN_<name>`` digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import setup, table
from .cuckoo import exact_dedup
from .interaction import AUDIT_SQL, interaction_audit
from .lattice import near_dedup
from .licences import licence_lines, licence_sql
from .linechunks import LINE_SQL, line_dedup
from .mixing import mixed_sizes
from .packing import pack
from .search import SEARCH_SQL, search
from .secrets import is_base, joined, scan_secrets
from .simhash import hex64, simhash_classes
from .suffix import remove_repeats
from .toxicity import fit, held_out, score_documents


def op1_lattice_near_dedup(spark, sf_dir):
    return near_dedup(table(setup(spark), sf_dir, "embeddings"))


def op2_toxicity_grammar(spark, sf_dir):
    docs = table(setup(spark), sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark, sf_dir):
    rows = exact_dedup(table(setup(spark), sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_licence_scan(spark, sf_dir):
    return licence_lines(table(setup(spark), sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    found = scan_secrets(table(setup(spark), sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", is_base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_suffix_dedup(spark, sf_dir):
    rows = remove_repeats(table(setup(spark), sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_chunk_dedup(spark, sf_dir):
    rows = line_dedup(table(setup(spark), sf_dir, "documents"))
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["lines"])
    names = F.transform("removed", lambda r: F.concat_ws("+", r["line"].cast("string"), r["lines"].cast("string")))
    return rows.select("doc_id", "n_lines", "n_chunks", F.size("removed").cast("long").alias("n_removed_chunks"),
                       lines.alias("n_removed_lines"), F.array_join(names, ",").alias("removed"))


def op8_simhash_near_dedup(spark, sf_dir):
    classes = simhash_classes(table(setup(spark), sf_dir, "documents"), shingle=3, max_bits=2)
    return classes.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def op9_mix_sources(spark, sf_dir):
    return mixed_sizes(table(setup(spark), sf_dir, "documents"))


def op10_pack_sequences(spark, sf_dir):
    return pack(table(setup(spark), sf_dir, "documents"))


def op11_filter_interactions(spark, sf_dir):
    setup(spark)
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked_search(spark, sf_dir):
    setup(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_codec(spark, sf_dir):
    coded = encode_documents(table(setup(spark), sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_lattice_near_dedup, op2_toxicity_grammar, op3_exact_dedup, op4_licence_scan, op5_secret_scan,
    op6_suffix_dedup, op7_line_chunk_dedup, op8_simhash_near_dedup, op9_mix_sources, op10_pack_sequences,
    op11_filter_interactions, op12_ranked_search, op13_bpe_codec)}

ORACLES: dict[str, str] = {
    "op11_filter_interactions": AUDIT_SQL,
    "op12_ranked_search": SEARCH_SQL,
    "op4_licence_scan": licence_sql(),
    "op7_line_chunk_dedup": LINE_SQL,
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST)""",
}
