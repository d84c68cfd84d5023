"""Operators that prepare a text corpus for training: filters, labels, copies, tokens, sequences."""
