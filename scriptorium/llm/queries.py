"""The queries of this subpackage: name -> function of (spark, sf_dir). SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import dartminhash, encoding, language, leakage, lexicon, lookalike, pages, pieces, simhash, site_lines
from scriptorium.storage import table


def _boilerplate(spark, sf_dir: str) -> DataFrame:
    return pages.boilerplate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "papers").select(F.col("body").alias("text")))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return _boilerplate(spark, sf_dir).distinct()


def p3_main_text(spark, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "documents"), _boilerplate(spark, sf_dir))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return dartminhash.document_pairs(*dartminhash.near_duplicates(table(spark, sf_dir, "documents"))).distinct()


def p4_groups(spark, sf_dir: str) -> DataFrame:
    return dartminhash.duplicate_groups(table(spark, sf_dir, "documents"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return simhash.cross_split(table(spark, sf_dir, "train_balanced")).select("sample_id_a", "sample_id_b").distinct()


def p1_counts(spark, sf_dir: str) -> DataFrame:
    return simhash.overlap_counts(table(spark, sf_dir, "train_balanced"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def p2_cleaned(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs))


def p2_spans_cleaned(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return site_lines.without_spans(docs, site_lines.repeated_spans(docs))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return language.wrong_labels(table(spark, sf_dir, "documents")).select("doc_id", "lang").distinct()


def p5_lines(spark, sf_dir: str) -> DataFrame:
    return language.line_languages(table(spark, sf_dir, "documents"))


def p5_documents(spark, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def _items(spark, sf_dir: str) -> DataFrame:
    return pieces.project_items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "papers"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return pieces.pieces(_items(spark, sf_dir)).where("n_pieces > 1").select("item_kind", "item_id").distinct()


def p6_pieces(spark, sf_dir: str) -> DataFrame:
    return pieces.pieces(_items(spark, sf_dir))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, sf_dir, "documents")).select("doc_id", "field").distinct()


def p7_restored(spark, sf_dir: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, sf_dir, "documents"))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return lexicon.encode(table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_cleaned(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, leakage.leaks(docs, table(spark, sf_dir, "eval_items")))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents")).distinct()


def p10_consistent(spark, sf_dir: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, sf_dir, "documents"))


def p10_groups(spark, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_cleaned, p2_spans_cleaned, p3_found, p3_main_text, p4_found, p4_groups, p5_found, p5_lines, p5_documents, p6_found, p6_pieces, p7_found, p7_restored, p8_ids, p9_found, p9_cleaned, p10_found, p10_consistent, p10_groups)}
SQL: dict[str, str] = {
    "p6_found": """
        SELECT 'chunk' AS item_kind, id AS item_id FROM chunks WHERE length(content) > 3000
        UNION SELECT 'paper', id FROM papers WHERE length(body) > 3000
    """,
}
