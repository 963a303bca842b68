"""Operators on unbounded inputs."""
