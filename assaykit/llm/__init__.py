"""Training-data operators for very large text corpora, one module per operator."""
