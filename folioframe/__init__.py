"""Narrative text analytics on Spark: DataFrame-to-DataFrame operators for documents, chapters and model data."""
