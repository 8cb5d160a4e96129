"""Operators for preparing large text corpora.

Nothing outside this folder imports it; ``registry`` lists the queries built
from the operators.
"""
