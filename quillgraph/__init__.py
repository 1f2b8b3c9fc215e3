"""quillgraph: graph-shaped document analytics on PySpark."""
