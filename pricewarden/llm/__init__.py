"""Training-data operators over a table of documents. Nothing else in the package imports this folder."""
