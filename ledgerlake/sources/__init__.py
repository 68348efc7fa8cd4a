"""Readers and writers of the files that the jobs exchange."""
