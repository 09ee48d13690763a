"""Operators for preparing training corpora: ten DataFrame-to-DataFrame functions and the queries that apply them."""
