"""Functions of the peptide engine."""
