"""viewloom: Spark-native operators for labelled time series and multi-view tables."""
