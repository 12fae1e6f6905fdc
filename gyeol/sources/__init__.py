"""Sources: parquet tables of a folder, versioned JSON artifacts, files of page text."""

from gyeol.sources.tables import json_artifact, page_files, table

__all__ = ["json_artifact", "page_files", "table"]
