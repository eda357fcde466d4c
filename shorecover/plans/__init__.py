"""The jobs: calibration, coverage, heatmap."""
