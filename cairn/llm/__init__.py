"""Training-data operators. Nothing outside this folder (and ``corpus_pipeline``) imports it."""
