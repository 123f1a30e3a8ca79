"""tidemark: change-impact, coverage and test-catalogue analytics as Spark plans."""
