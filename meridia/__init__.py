"""meridia: a Spark-native analytics engine for transit service and heat exposure."""
