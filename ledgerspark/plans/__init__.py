"""Jobs composed from the operators, and the registered queries with their inputs."""
