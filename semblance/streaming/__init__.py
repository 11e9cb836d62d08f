"""Live progress of runs."""
