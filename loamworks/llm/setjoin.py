"""Signatures of the set similarity join, under the name that the training-data operators use."""

from loamworks.operators.setjoin import INDEX, LESS, PROBE, Bands, matches, signatures

__all__ = ["INDEX", "LESS", "PROBE", "Bands", "matches", "signatures"]
