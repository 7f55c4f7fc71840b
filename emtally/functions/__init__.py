"""Library types, fragment lengths and effective lengths."""
