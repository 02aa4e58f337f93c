"""factflow: a PySpark-native reactive query engine over (entity, attribute, value) facts."""
