"""quarry: retrieval, document-quality and rule analytics as Spark DataFrame plans."""
