"""Readers of files and folders, and the store of experiments."""
