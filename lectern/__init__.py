"""A Spark engine for document collections and bibliographic records."""
