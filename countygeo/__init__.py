"""County-level geolocation data and evaluation jobs for Spark."""
