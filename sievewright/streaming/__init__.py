"""Incremental forms of the batch operators; an extension, batch results are the reference."""
