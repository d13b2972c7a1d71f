"""Operators for building training corpora at scale (extraction, filtering, dedup, tokens).

Nothing outside this subpackage imports it. Every operator selects just the columns it
needs, so extra columns of any name do no harm; a null text is an empty text; an empty
table gives an empty result with the same columns.
"""
