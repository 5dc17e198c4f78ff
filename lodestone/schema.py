"""Schemas of what is read and written."""

from __future__ import annotations

MANUAL_INDEX = "id string, date_created bigint, last_modified bigint, creation_date bigint, last_updated bigint, chunks array<variant>"
CHUNK = "id string, title string, content string, keywords array<string>, negativeKeywords array<string>, relevantChunksIds array<string>, parameters array<string>, position int"
STORE = "dataset_id string, id string, title string, content string, keywords array<string>, negativeKeywords array<string>, relevantChunksIds array<string>, parameters array<string>, position int, num_tokens int, vector array<double>, norm double"
RELATED = "id string, title string, content string, num_tokens int, skip boolean, position int, skip_reason string"
SOURCE = f"content string, score double, title string, relevantChunks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in RELATED.split(', '))}>>, num_tokens int, skip boolean, position int, skip_reason string"
POWER = "cpu_kWh double, gpu_kWh double, ram_kWh double, total_kWh double, duration double"
#: What every annotated chunk must have; anything less is a plain text item.
CHUNK_KEYS = ("id", "title", "content", "keywords", "negativeKeywords", "relevantChunksIds", "parameters")
