"""Spark-native indexing and search of web archives.

Subpackages:
  functions  - Column expressions (URLs, timestamps, text, hashes, presentation)
  sources    - archive reader, capture (CDX) reader, driver-table derivations, sinks
  operators  - extraction, link graph, version documents, index, search, captures, metadata
  plans      - end-to-end jobs (indexing chain, batch text search, CLI)
  streaming  - incremental ingestion of new page tables into the link graph
"""

__version__ = "0.1.0"
