"""Analytics over bundles of files as Spark DataFrames: classify, score, select, scan, redact, pack and describe them."""
