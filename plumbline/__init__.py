"""plumbline: learned-index, compressed-integer and trace analytics on PySpark DataFrames."""
