"""Reading and writing tables, load marks, and the adapter for the driver's test tables."""
