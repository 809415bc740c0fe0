"""Graph construction, vertex programs, algorithms and their validators."""
