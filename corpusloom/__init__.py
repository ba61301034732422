"""corpusloom: corpus analytics as Spark DataFrame operators."""
