"""Operators for preparing language-model training data at corpus scale.

Every module is self-contained behind DataFrames: an operator takes a DataFrame
and returns a DataFrame. Nothing outside this subpackage imports it.
"""
