"""searchloom: search-performance and site-audit analytics as Spark jobs."""
