"""tidemark: capacity analytics on Spark, and operators for text corpora in :mod:`tidemark.llm`."""
