"""strandline: a PySpark-native engine for evidence-dependence evaluation of question answering over recordings."""
