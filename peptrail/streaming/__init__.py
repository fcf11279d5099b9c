"""Streaming of the peptide engine."""
