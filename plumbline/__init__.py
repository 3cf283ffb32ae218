"""Retrieval and document-cleaning evaluation as DataFrame plans."""
