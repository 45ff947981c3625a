"""geomart: a Spark-native geospatial housing data-mart library.

Every public operator is a ``DataFrame -> DataFrame`` function built from
built-in column expressions, so Catalyst can prune, push down and codegen
the whole plan. Sub-packages:

- ``sources``    batch scans, landings, file parsing, run logs
- ``functions``  column-expression builders (hex cells, polygon rings, text)
- ``operators``  relational building blocks (snapshots, reshape, bridges, marts)
- ``streaming``  incremental file landings with Structured Streaming
- ``plans``      the registered queries over the shared test tables
"""

__version__ = "0.1.0"
