"""Inputs, outputs and written tables."""
