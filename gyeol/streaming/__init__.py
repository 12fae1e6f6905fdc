"""Usage as streams: daily quota, in-flight duplicates, job states, resumable ingest."""
