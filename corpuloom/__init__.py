"""corpuloom: text-corpus, user and network analytics as Spark DataFrame programs."""
