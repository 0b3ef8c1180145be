"""texloom: processing of scientific documents as Spark DataFrame transformations.

Operators take and return DataFrames.  Docstrings name the survey IDs they cover.
"""
