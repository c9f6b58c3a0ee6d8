"""Operators that a pipeline for training data of language models needs."""
