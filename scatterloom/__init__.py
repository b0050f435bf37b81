"""Scattering signals from molecular-dynamics trajectories on Spark."""
