"""codestrata: a code-knowledge-graph and analytics engine on PySpark DataFrames."""
