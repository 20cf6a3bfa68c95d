"""lectern: DataFrame operators for bibliographic and document corpora on Spark."""
