"""Operators for preparing training data: text, embeddings, pages and conversations.

Every operator takes a DataFrame and names of the columns it reads, ignores all other columns (so
extra columns with any name are harmless) and returns a DataFrame with the columns its docstring lists.
"""
