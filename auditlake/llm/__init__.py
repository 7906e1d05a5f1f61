"""Operators for training data: each module is one operator with its general interface."""
