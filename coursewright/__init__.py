"""Set-at-a-time analytics over educational content and the people who learn from it.

Every operator is a function from DataFrames to DataFrames; nothing here runs an
action except the two fixpoint loops in ``operators.trees``.
"""
