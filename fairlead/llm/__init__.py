"""Operators for training corpora. Nothing else in fairlead imports this subpackage."""
