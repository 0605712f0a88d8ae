"""Training-data operators: ten distributed jobs over documents, pages, labels and embeddings.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames;
`registry` binds the production queries.
"""
