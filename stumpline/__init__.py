"""Ball-by-ball match analytics as Spark DataFrame plans."""
