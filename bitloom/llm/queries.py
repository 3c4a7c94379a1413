"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, chat_expansion, decontamination, hard_negatives, license_scan, packing, pii, ppm, quality_rules, simhash, toxicity, url_rules, warc
from .common import read_table


def op1_crf_spans(spark, sf_dir):
    return toxicity.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_line_frequency(spark, sf_dir):
    return quality_rules.query(read_table(spark, sf_dir, "documents"))


def op3_histogram_packing(spark, sf_dir):
    return packing.query(read_table(spark, sf_dir, "documents"))


def op4_prefix_targets(spark, sf_dir):
    return chat_expansion.query(chat_expansion.with_planted(read_table(spark, sf_dir, "conversations")))


def op5_simhash_tiles(spark, sf_dir):
    return simhash.query(read_table(spark, sf_dir, "documents"))


def op6_license_automaton(spark, sf_dir):
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op7_winnowing(spark, sf_dir):
    return decontamination.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_weak_supervision(spark, sf_dir):
    return pii.judge(read_table(spark, sf_dir, "documents"))


def op9_ppm(spark, sf_dir):
    return ppm.query(read_table(spark, sf_dir, "documents"))


def op10_digest_array(spark, sf_dir):
    return url_rules.judge(read_table(spark, sf_dir, "pages"))


def op11_walsh_hadamard(spark, sf_dir):
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_warc_ranges(spark, sf_dir):
    return warc.query(read_table(spark, sf_dir, "pages"))


def op13_str_rtree(spark, sf_dir):
    return hard_negatives.query(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_spans,
        op2_line_frequency,
        op3_histogram_packing,
        op4_prefix_targets,
        op5_simhash_tiles,
        op6_license_automaton,
        op7_winnowing,
        op8_weak_supervision,
        op9_ppm,
        op10_digest_array,
        op11_walsh_hadamard,
        op12_warc_ranges,
        op13_str_rtree,
    )
}
#: The others' results depend on XXH64, a tokenizer or a trained model; tests hold them against brute force.
ORACLE_SQL = {
    "op2_line_frequency": quality_rules.ORACLE,
    "op4_prefix_targets": chat_expansion.ORACLE,
    "op7_winnowing": decontamination.ORACLE,
    "op10_digest_array": url_rules.ORACLE,
    "op11_walsh_hadamard": centroids.ORACLE,
    "op12_warc_ranges": warc.ORACLE,
    "op13_str_rtree": hard_negatives.ORACLE,
}
