"""End-to-end estimation, and the registered queries."""
