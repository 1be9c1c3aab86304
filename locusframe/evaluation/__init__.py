"""Evaluation of calls against a truth."""
