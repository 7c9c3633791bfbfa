"""Change-data capture, net-change collapse and two-way sync on PySpark."""
