"""Column-level functions: paths, clocks, names, places, scores. All stay inside the JVM."""
