"""Company-page collection, extraction and scoring as Spark DataFrame operators."""
