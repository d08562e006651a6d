"""Reading and writing tables, example files, reports and the call log."""
