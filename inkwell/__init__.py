"""inkwell: document search and corpus processing as Spark DataFrame plans."""
