"""Knowledge-graph construction, linking, checking and alignment as Spark DataFrame plans."""
