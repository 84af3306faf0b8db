"""SQL analysis on Spark's own parsed plans, and the compilation of a project into a graph."""
