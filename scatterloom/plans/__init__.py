"""The scattering pipeline: amplitudes, time series, averaged signals, results."""
