"""stratalog: version-control history, and other corpora, as Spark relations."""
