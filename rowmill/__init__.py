"""rowmill: relational, versioned-table and training-data operators as Spark jobs."""
