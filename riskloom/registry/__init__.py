"""Named queries over the sample tables, each with the SQL it is checked against."""
