"""Market-regime analytics over long bar tables, expressed as lazy Spark DataFrame plans."""
