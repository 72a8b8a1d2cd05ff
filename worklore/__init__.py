"""worklore: work-knowledge tables, search and reports as Spark jobs."""
