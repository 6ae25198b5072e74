"""sparkwire: a Spark-first engine for curating syndicated content."""
