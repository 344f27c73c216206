"""gridloom: a PySpark-native engine for label fusion over gridded data."""
