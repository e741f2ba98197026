"""Operators for corpora of text: calls of models, documents, code.

Self-contained on top of ``tracewright.session``; nothing outside imports it.
"""
