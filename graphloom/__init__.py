"""Graph-query and corpus analytics expressed as Spark plans."""
