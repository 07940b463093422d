"""tessera: keyed-collection analytics on PySpark DataFrames."""
