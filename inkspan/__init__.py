"""inkspan: press analytics as Spark jobs."""
