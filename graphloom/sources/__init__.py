"""Tables and file trees as DataFrames."""
