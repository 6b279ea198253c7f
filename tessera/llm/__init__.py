"""Operations of a training-data pipeline: ten operators over documents and embeddings.

Nothing else in the package imports this subpackage.
"""
