"""Date-aware document retrieval and evaluation, expressed as Spark plans."""
