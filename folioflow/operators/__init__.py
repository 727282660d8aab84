"""Operators over DataFrames: graphs, retrieval, extraction, evaluation, validation and lifecycle."""
