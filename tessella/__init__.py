"""A PySpark engine for localisation data: documents in many formats as tables of segments, and operators over them."""
