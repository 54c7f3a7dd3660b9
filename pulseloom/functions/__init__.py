"""Column-level building blocks: bit fields, waveforms, calibration."""
