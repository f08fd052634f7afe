"""codeloom: code-intelligence and retrieval analytics, and training-corpus operators, as Spark DataFrame plans."""
