"""Readers and writers of sequence and pileup files."""
