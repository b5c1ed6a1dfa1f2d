"""Tables: catalogs, readers and writers."""
