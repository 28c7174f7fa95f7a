"""Ready plans: the build, the fixture graph and the query catalogue."""
