"""Composed jobs: ingest, training, summaries, report, artifact."""
