"""Operations of a large-scale training-data pipeline, as Spark jobs.

Each module holds one operator with a general interface and the query that
applies it to its whole table; :mod:`firnlight.llm.registry` gathers the queries.
Nothing else in the library imports this subpackage.
"""
