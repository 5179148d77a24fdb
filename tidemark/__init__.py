"""tidemark: ordered-signal analytics expressed as Spark DataFrame plans."""
