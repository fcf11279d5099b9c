"""Plans of the peptide engine."""
