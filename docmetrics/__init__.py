"""Documentation analytics over large corpora of Python source, as Spark jobs."""
