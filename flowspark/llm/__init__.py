"""Operators for building training data at corpus scale; nothing else in the package imports these."""
