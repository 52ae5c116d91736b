"""Web-page and text analytics as Spark DataFrame transformations."""
