"""quillvec: vector search and training-data operators on PySpark DataFrames."""
