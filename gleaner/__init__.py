"""gleaner: Spark-native commit analytics and training-data operators."""
