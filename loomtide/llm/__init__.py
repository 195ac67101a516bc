"""Operators for building training corpora: fingerprints, classifiers, joins, tokenizers and mixing over Spark DataFrames."""
