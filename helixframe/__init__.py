"""DNA sequence-pair analytics expressed as Spark DataFrame plans."""
