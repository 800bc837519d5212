"""loomtext: document-localisation analytics expressed as PySpark DataFrame plans."""
