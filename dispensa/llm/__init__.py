"""Training-data operators over DataFrames of documents and vectors; nothing else in the library imports this package."""
