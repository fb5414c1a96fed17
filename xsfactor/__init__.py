"""PySpark-native analytics over entity x time panels."""
