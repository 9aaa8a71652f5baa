"""Document analytics on Spark: retrieval, link graphs, audits and change feeds as DataFrame operators."""
