"""All queries of this subpackage, with SQL where there is some."""

from hindcast.llm import decontamination, language_id, lm_scoring, mixing, near_dedup, nearest, quality, substring_dedup, token_counts, warc

MODULES = (near_dedup, mixing, substring_dedup, language_id, warc, nearest, quality, decontamination, lm_scoring, token_counts)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
