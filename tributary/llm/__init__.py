"""Operators for building training data: matching, grouping, consolidation, tokens, packing and template residue."""
