"""Whole question-answering and scheduling flows composed from the operators."""
