"""Sources of the peptide engine."""
