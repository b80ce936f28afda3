"""codeloom: a Spark-first analytics engine for source-code catalogs."""
