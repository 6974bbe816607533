"""Operators for preparing large text corpora: cleaning, deduplication, scanning, tokenizing."""
