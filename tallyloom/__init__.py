"""Training-data curation and evaluation operators as PySpark DataFrame functions."""
