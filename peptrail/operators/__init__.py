"""Operators of the peptide engine."""
