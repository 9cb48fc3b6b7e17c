"""Training-data operators: token files, token counts, neighbour search, language
identification, SentencePiece coding, substring and near-duplicate removal, document
fingerprints, web archives and sequence packing.

Nothing outside this subpackage imports it, except the driver entry and
``corpus_pipeline.py``.  The modules must be importable on the executors.
"""
