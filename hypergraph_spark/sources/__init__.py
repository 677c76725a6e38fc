"""Readers, writers, generators and datasets."""
