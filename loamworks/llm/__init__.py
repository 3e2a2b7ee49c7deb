"""Operators for training corpora of language models; nothing else in the library imports these."""
