"""Training-data operators: formatting, joins, archives, classifiers, ledgers, packing and scans.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
