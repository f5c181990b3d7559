"""Tables, derived views and file formats."""
