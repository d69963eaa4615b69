"""corpuslab: PySpark operators for text corpora and time-stamped annotations."""
