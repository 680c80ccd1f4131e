"""Column builders. Nothing here looks at a DataFrame."""
