"""granary: document, code and conversation analytics as Spark DataFrame transformations."""
