"""millrace: curation, retrieval, scoring and measuring of training data on Spark."""
