"""Sources: folders of files as DataFrames."""
