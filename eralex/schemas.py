"""Explicit schemas of the project's datasets."""

from __future__ import annotations

SECTION = "array<struct<statute:string,section_no:string>>"
JUDGMENT = f"judgment_id string, case_name string, court string, date string, bench array<string>, sections_cited {SECTION}, text string, disposal string"
ENVELOPE = f"judgments array<struct<judgment_id:string,case_name:string,court:string,date:string,bench:array<string>,sections_cited:{SECTION},text:string,disposal:string>>"
VOTE = "ipc_section string, bns_section string, description string, source string"
PROVISION = "statute string, section_no string, marginal_note string, text string, needs_review boolean"
QA = "id string, query string, query_date date, slice string, gold_section_no string, gold_statute string"
MANIFEST = "cnr string, case_name string, date date, judge string, court string, s3_key string, local_path string"
CITATION = "citing_judgment_id string, cited_case_name string, cited_year string, cited_judgment_id string, signal string, context string"
