"""Physical strategies that Catalyst cannot choose alone, and whole runs built from operators."""
