"""Graph-driven document denormalization on Spark DataFrames.

Documents declare rules that turn references into owned edges (operators.extract); the union of the edges is
a property graph kept as DataFrames (operators.graph); walks follow it (operators.walk), the reached
documents are joined back (operators.resolve) and reduced to computed attributes (operators.reduce), which
are merged with a filtered and transformed copy of each document (operators.recompute). Changes are applied
incrementally (operators.dirty, streaming).
"""
