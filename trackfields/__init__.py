"""trackfields: PySpark jobs for event tracks, gridded fields and large document collections."""
