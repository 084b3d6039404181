"""facetmill: a Spark-native engine that maps large collections of conversations and documents."""
