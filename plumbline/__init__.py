"""Evaluation analytics over DataFrames: scores in; metrics, comparisons, verdicts, checks and labels out."""
