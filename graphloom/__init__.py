"""Code-graph analytics on Spark: facts, links, findings, diffs and queries as DataFrame jobs."""
