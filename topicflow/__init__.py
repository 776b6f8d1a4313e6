"""Topic analytics over article collections, written as Spark DataFrame jobs."""
