"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their DuckDB twins.
"""
