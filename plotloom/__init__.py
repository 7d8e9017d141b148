"""Plotloom: dialogue, question and answer analytics on Spark DataFrames."""
