"""Operations of a training-data pipeline on text corpora.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
