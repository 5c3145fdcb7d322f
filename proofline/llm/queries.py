"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.llm import contamination, docpairs, handwritten, history, packing, prose, validity
from proofline.session import table

QUERIES = {
    "p1_found": lambda s, d: validity.broken_files(table(s, d, "file_facts")),
    "p1_rates": lambda s, d: validity.broken_rates(table(s, d, "file_facts")),
    "p2_found": lambda s, d: docpairs.documented_functions(table(s, d, "file_facts")),
    "p2_pairs": lambda s, d: docpairs.code_doc_pairs(table(s, d, "file_facts")),
    "p4_found": lambda s, d: handwritten.not_handwritten(table(s, d, "file_facts"), table(s, d, "repos")).select("file_id"),
    "p4_reasons": lambda s, d: handwritten.not_handwritten(table(s, d, "file_facts"), table(s, d, "repos"))
    .groupBy("reason").agg(F.count("*").alias("files")),
    "p5_found": lambda s, d: history.repeats_by_batches(table(s, d, "findings")),
    "p6_containers": lambda s, d: packing.containers(table(s, d, "documents"), table(s, d, "context_sizes")),
    "p6_fill": lambda s, d: packing.fill(
        packing.containers(table(s, d, "documents"), table(s, d, "context_sizes")), table(s, d, "context_sizes")
    ),
    "p7_found": lambda s, d: contamination.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select(
        "doc_id", "item_id"
    ),
    "p7_items": lambda s, d: contamination.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_found": lambda s, d: prose.not_prose(table(s, d, "documents")).select("doc_id").distinct(),
    "p8_stats": lambda s, d: prose.document_statistics(table(s, d, "documents")),
}
ORACLE: dict[str, str] = {}
