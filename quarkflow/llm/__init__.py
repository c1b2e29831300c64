"""Training-data operators: licence scan, WARC, language, toxicity, near-duplicates, tokens and packing.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
