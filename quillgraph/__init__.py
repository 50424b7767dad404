"""Knowledge-graph, memory and text analytics expressed as Spark DataFrame plans."""
