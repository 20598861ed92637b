"""Operators for large-scale language-model training data (problems 1-5 and 7-9 of TESTDATA.md)."""
