"""docloom: a PySpark-native engine for curating Markdown and web-page corpora."""
