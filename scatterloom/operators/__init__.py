"""Relational operators on trajectories, atoms, scattering vectors and constants."""
