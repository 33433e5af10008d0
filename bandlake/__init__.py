"""Image, annotation and corpus analytics as Spark DataFrame operators."""
