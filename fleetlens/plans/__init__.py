"""Views and reports built from the operators."""
