"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it, and the subpackage imports nothing
from the rest of the library.
"""
