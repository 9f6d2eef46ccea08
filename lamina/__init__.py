"""lamina: analytics over versioned records, expressed as Spark DataFrame plans."""
