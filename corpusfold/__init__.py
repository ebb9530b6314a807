"""Token-budgeted context documents from a corpus of files, as Spark jobs."""
