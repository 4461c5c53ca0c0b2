"""Operations of a training-data pipeline over text corpora (Spark DataFrames in and out).

Nothing else in the library imports this subpackage.
"""
