"""Native column functions: nothing here leaves the JVM."""
