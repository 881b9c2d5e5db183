"""tollgate: governance checks for AI traffic as Spark DataFrame jobs."""
