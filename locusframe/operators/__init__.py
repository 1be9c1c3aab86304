"""Operators over positions, intervals and votes."""
