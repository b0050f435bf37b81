"""Reading structures, trajectories, selections and parameter tables from files."""
