"""Column expressions: text handling, number reading, labels."""
