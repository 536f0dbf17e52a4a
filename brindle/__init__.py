"""Web-text retrieval, link analysis and keyed datasets on Spark DataFrames."""
