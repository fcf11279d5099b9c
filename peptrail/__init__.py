"""Peptide search and analysis over protein tables, as Spark jobs."""
