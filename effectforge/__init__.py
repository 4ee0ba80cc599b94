"""effectforge: Bayesian marker-effect analytics expressed on Spark DataFrames."""

__version__ = "0.1.0"
