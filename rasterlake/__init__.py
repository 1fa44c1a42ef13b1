"""rasterlake: a PySpark-native engine for collections of image files and their bytes."""
