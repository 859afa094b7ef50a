"""Sources and sinks of cubes."""
