"""A typed node-graph query engine on PySpark."""
