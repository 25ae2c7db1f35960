"""A corpus compiler and lexical and graph query engine on PySpark DataFrames."""
