"""Log normalisation and analytics as DataFrame-to-DataFrame functions on Spark."""
