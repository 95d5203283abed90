"""The corpus pipeline over documents: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns that it got; the last
returns the packed pieces. Decisions travel as rows of two numbers, doc_id and a hash of doc_id and text; texts are
shuffled only where a decision may concern them. Documents left without a word by a dedup stage go.

Null texts count as empty and fail the quality rules; rows without doc_id are judged by quality rules and packed, and
no dedup stage changes them; rows that share a doc_id are documents of their own; equal rows share their fate; very long texts
are taken whole; empty tables pass through; further columns, of any name, pass through unchanged (n_chars follows the text).
"""

from __future__ import annotations

from hearthline.llm import line_dedup, minhash, packing, quality, substring_dedup
from hearthline.llm.common import read, replaced, table, without
from hearthline.llm.queries import tokenizer_file


def _edited(docs, edits):
    """docs with the edited texts, without those in which no word is left."""
    edits = table(edits.select("doc_id", "row", "text", "n_words"))
    worded = replaced(without(docs, edits.where("n_words = 0")), edits.where("n_words > 0"))
    return worded.select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark, docs, sf_dir):
    return without(docs, quality.judge(docs).where("NOT kept").select("doc_id", "row"))


def lines(spark, docs, sf_dir):
    return _edited(docs, line_dedup.dedup(docs))


def near_duplicates(spark, docs, sf_dir):
    return without(docs, minhash.classes(docs).where("NOT kept").select("doc_id", "row"))


def substrings(spark, docs, sf_dir):
    return _edited(docs, substring_dedup.dedup(docs))


def packed(spark, docs, sf_dir):
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("minhash", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packed),
]

#: SQL can't express packing or MinHash; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
