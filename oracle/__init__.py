"""Input views over the test tables and the SQL that results are compared with."""
