"""Schemas of the data that passes between stages."""

from __future__ import annotations

WORDS = "document string, page int, page_width double, ord int, text string, x0 double, x1 double, top double, bottom double"
PAGE = "page int, text string, statement_type string, table_rows array<struct<label:string,values:array<string>,columns:array<string>>>"
PROCESSED = f"document string, company string, fiscal_year string, statement_level string, statement_pages map<string,array<int>>, pages array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in PAGE.split(', '))}>>"
CHUNK = "chunk_id string, document string, company string, fiscal_year string, chunk_type string, section string, pages array<int>, text string"
EXPORT = "id string, text string, document string, company string, fiscal_year string, chunk_type string, section string, pages string"
