"""Literature-metadata preparation as Spark DataFrame transforms."""
