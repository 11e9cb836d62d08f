"""Profile, prepare, synthesise and compare labelled tables on Spark."""
