"""Inputs (test-table readers, derived advertising inputs) and sinks."""
