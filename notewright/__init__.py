"""Note-processing and knowledge-linking operators on PySpark DataFrames."""

__version__ = "0.1.0"
