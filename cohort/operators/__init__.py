"""Operators: preparation, reports, chart data, model, retrieval, conversations."""
