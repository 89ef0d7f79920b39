"""Music-revenue reporting on Spark: sheet intake, monthly fact load, reports."""
