"""tessellum - corpus, retrieval and evaluation analytics on PySpark DataFrames."""
