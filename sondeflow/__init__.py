"""sondeflow: ordered-sequence analytics written as Spark plans."""
