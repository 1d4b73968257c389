"""photolake: PySpark operators for large photo and video catalogues."""
