"""PySpark-native analytics over puzzle catalogues, play data and text corpora."""
