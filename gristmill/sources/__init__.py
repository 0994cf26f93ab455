"""Files of several forms as DataFrames, and DataFrames as files."""
