"""Explicit schemas of the entities that the library reads and writes."""

from __future__ import annotations

RAW_RECORD = (
    "patent_id string, publication_number string, title string, domain string, abstract string, claims array<string>, "
    "description string, snippet string, inventor string, assignee string, filing_date string, grant_date string, "
    "publication_date string, priority_date string, patent_link string, language string, country_status map<string,string>"
)
CLEAN_RECORD = (
    "patent_id string, publication_number string, title string, domain string, abstract_clean string, claims_clean array<string>, "
    "description_clean string, abstract_processed string, claims_processed string, description_processed string, inventor string, "
    "assignee string, filing_date string, grant_date string, publication_date string, language_detected string, "
    "token_count_raw int, token_count_clean int"
)
CHUNK = "doc_id long, chunk_index int, text string"
ASSIGNMENT = "vec_id long, domain_true string, cluster int"
