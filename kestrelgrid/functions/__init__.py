"""Column builders: text, patterns, scores, dates."""
