"""quarrylight: retrieval and document analytics as declarative Spark plans."""
