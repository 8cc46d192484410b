"""A PySpark-native analytics engine for restaurant-chain tables."""
