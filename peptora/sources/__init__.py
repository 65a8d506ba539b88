"""Readers and writers of sequence, table and tool-output files."""
