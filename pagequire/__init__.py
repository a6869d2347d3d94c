"""Page-layout analytics over whole corpora, written as DataFrame, SQL and Structured Streaming jobs."""
