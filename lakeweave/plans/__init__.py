"""Driver-side planning: patterns to ranges, spans to pieces."""
