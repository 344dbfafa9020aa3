"""Keyed linear algebra, estimation and spectra on Spark DataFrames."""
