"""Line operators, telemetry reports, repository graph operators and projections."""
