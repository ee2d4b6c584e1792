"""Compilation of nested operations to DataFrame plans."""
