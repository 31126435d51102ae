"""Reading and writing tables, and the machine-shaped views of the test tables."""
