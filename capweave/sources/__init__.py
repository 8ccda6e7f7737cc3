"""Inputs and outputs: rule files, capture tables, archive files."""
