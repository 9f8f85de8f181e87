"""Operators for building training text at scale: filtering, deduplication, decontamination, tokens, archives."""
