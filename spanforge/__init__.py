"""Span-labelling analytics on Spark: corpora, spans, taggers, gates."""
