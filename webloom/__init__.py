"""Web corpora as DataFrames: clone, crawl, rewrite and archive pages on Spark."""
