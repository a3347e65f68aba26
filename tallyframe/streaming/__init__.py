"""Structured Streaming forms of row-wise gates and exact dedup. An extension: batch forms stand in operators."""
