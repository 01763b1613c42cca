"""Record linkage, set metrics and corpus preparation as Spark DataFrame operators."""
