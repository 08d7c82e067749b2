"""Corpus-scale palette, mask, region and outline analytics on Spark DataFrames."""
