"""waraq: document-structure analytics expressed on Spark DataFrames."""
