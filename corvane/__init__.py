"""corvane: document retrieval, text analytics and corpus preparation on Spark."""
