"""Document question-answering data pipelines as Spark plans."""
