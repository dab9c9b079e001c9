"""Training-data operators: ten corpus-scale stages on documents and embeddings.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
