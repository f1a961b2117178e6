"""Operations of a training-data pipeline over documents, benchmarks and conversations.

Each module holds one operator with its own interface; ``queries`` binds them
to the tables.  Nothing else in the library imports this package.
"""
