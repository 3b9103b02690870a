"""stancemill: Spark-first assembly and analysis of page collections that answer yes/no questions."""
