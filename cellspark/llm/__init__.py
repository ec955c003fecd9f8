"""Training-data operators: filters, dedup, classifiers and tokenisation on DataFrames.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with an id column and a text (or url, html) column and returns a DataFrame;
further columns of the input are ignored unless the docstring says otherwise.
"""
