"""Graph, sparse-matrix and corpus analytics on PySpark DataFrames."""
