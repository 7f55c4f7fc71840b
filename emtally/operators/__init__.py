"""Filters, equivalence classes, EM, replicates and TPM."""
