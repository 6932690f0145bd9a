"""Registry search, ancestry, record matching and incremental upserts as Spark jobs."""
