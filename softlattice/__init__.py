"""A PySpark-native engine for regularised softmax models over tables."""
