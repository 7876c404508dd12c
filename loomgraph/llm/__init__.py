"""Operators for preparing training text: dedup, filters, tokenisers, language model scores."""
