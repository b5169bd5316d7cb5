"""Reading and writing files, tables and stored pages."""
