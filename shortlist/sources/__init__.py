"""Readers, writers and the text side of file intake."""
