"""Readers and writers of samples, features and results."""
