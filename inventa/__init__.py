"""Analytics over item occurrences, written as plain Spark DataFrame transformations."""
